"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo parts; null ids are in fold 0 of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def bounded_sample(labels: DataFrame, label: str, per_class: int, classes: list | None = None) -> DataFrame:
    """(doc_id, label) of at most per_class ids of each class, the least by a hash of the id.

    One scan counts the classes and one takes the ids under a hash that leaves a quarter
    more than are wanted of each, so the ranking sees a bounded number of rows a class.
    The counts go to where rows are read, so that no other row is shuffled: there is one a
    class, and the model that the driver holds has a row for each, too.
    classes names those to take; else all are.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if classes is not None:
        rows = rows.where(F.col(label).isin(classes))
    rows = rows.select("doc_id", F.col(label).alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 40)).alias("_h"))
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("_n"))
    limit = ((per_class * 1.25 + 200) / F.col("_n") * float(1 << 40)).cast("double")
    sizes = sizes.select(F.col("label").alias("_l"), F.least(limit, F.lit(float(1 << 40))).alias("_most"))
    some = rows.join(F.broadcast(sizes), F.col("label") == F.col("_l")).where("_h < _most").select("doc_id", "label", "_h").distinct()
    nth = F.row_number().over(W.partitionBy("label").orderBy("_h", "doc_id"))
    return some.withColumn("_k", nth).where(F.col("_k") <= per_class).select("doc_id", "label")


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the sampled documents, whole texts.

    The sample's size is bounded by its parameters, so it is broadcast and the texts
    are filtered where they are read.
    """
    rows = F.broadcast(sample.select(F.col("doc_id").alias("_id"), "label"))
    return docs.select("doc_id", "text").join(rows, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
