"""The corpus pipeline: five stages over documents, each written before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import stages
from loomtext.llm.common import scratch_root, write

STAGES = [
    ("toxicity", stages.toxicity),
    ("exact_dedup", stages.exact_dedup),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("packing", stages.packing),
]

#: Learned scores, 64-bit fingerprints and a tokenizer are beyond SQL; the tests hold
#: run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and reread.

    What a stage writes for itself goes when its result is written. The stages' results stay:
    they are what a rerun after a failure goes on from.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        docs = write(stage(spark, docs, sf_dir), f"{folder}/{name}")
    stages.tidy(spark)
    return docs
