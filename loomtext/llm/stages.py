"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame.

All but packing return the columns of the documents they were given. A stage's result has
to be written before the next stage is called: that one begins by deleting the tables that
the stage before wrote for itself. tidy() does so after the last.

Null and empty texts, repeated rows and ids, null ids, very long texts and columns with
clashing names are as the operators define them, and every row is judged for itself:
toxicity scores null as the empty text; exact and near dedup keep one row of each group,
empty texts being one group; decontamination keeps what has no words; packing gives an
empty text its end id. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .common import discard, scope, small_batches

_left: list[str] = []


def tidy(spark: SparkSession) -> None:
    """Delete the tables that the last stage wrote for itself, once its result is written."""
    discard(spark, _left)


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        with scope(spark, keep=_left):
            return fn(spark, docs, sf_dir)

    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    from . import toxicity as op

    small_batches(spark)
    model = op.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op.keep_clean(docs, model)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    from . import exact_dedup as op

    small_batches(spark)
    return op.dedup(docs)


@_stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 over five-word shingles), the row with the smallest doc_id.

    SimHash fingerprints and their deletion variants find near copies first, verified on whole
    shingle sets; an exact search finds those that fingerprints do not reach.
    """
    from . import near_copies as op

    small_batches(spark)
    return op.dedup(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    from . import decontaminate as op

    return op.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    from . import packing as op

    small_batches(spark)
    return op.pack(docs)
