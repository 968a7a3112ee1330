"""Audits: coverage, counts, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uncovered(rows: DataFrame, keys: Sequence[str], *covers: DataFrame) -> DataFrame:
    """Rows whose key is in none of the covers: one anti join against their distinct union."""
    every = covers[0].select(*keys)
    for c in covers[1:]:
        every = every.union(c.select(*keys))
    return rows.join(every.distinct(), list(keys), "left_anti")


def assert_covered(rows: DataFrame, keys: Sequence[str], *covers: DataFrame) -> None:
    """Raise if any row is lost; at most a few lost keys are fetched for the message."""
    lost = uncovered(rows, keys, *covers).select(*keys).take(5)
    if lost:
        raise ValueError(f"rows that no scene or preamble holds: {[tuple(r) for r in lost]} ...")


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n, ok): rows of each table, and those with status ok where it has one."""
    out = None
    for name, df in tables.items():
        ok = F.count_if(F.col("extract_status") == "ok") if "extract_status" in df.columns else F.lit(None).cast("long")
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), ok.alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def with_records(scenes: DataFrame, records: DataFrame, key: str = "scene_id") -> DataFrame:
    """Scenes with their records; those without one are pending."""
    marked = records.withColumn("_ok", F.lit("ok"))
    return scenes.join(marked, key, "left").withColumn("extract_status", F.coalesce("_ok", F.lit("pending"))).drop("_ok")


def todo(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows that a cache has no result for."""
    return rows.join(cache.select(key), key, "left_anti")


def chapter_sets(edges: DataFrame, sets: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges with chapters: the sorted union of the chapter sets (name, chapters) of both ends."""
    none = F.array().cast(sets.schema["chapters"].dataType)
    left = sets.select(F.col("name").alias(a), F.col("chapters").alias("_x"))
    right = sets.select(F.col("name").alias(b), F.col("chapters").alias("_y"))
    both = edges.join(left, a, "left").join(right, b, "left")
    return both.withColumn("chapters", F.array_sort(F.array_union(F.coalesce("_x", none), F.coalesce("_y", none)))).drop("_x", "_y")
