"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node.

    Alternating large-star and small-star rounds: each links nodes straight to the
    least neighbour that they know of, until every component is a star around its
    least node, in a number of rounds that grows with the logarithm of the size.
    Every round is written to the shared folder, so a lost executor costs one round
    at most. Minima use partial aggregation; hubs meet only in equi-joins, which
    adaptive execution splits.
    """
    now = materialize(
        edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").select("a", "b").distinct(),
        "edges",
    )
    before = _state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("r")).select(F.col("a").alias("w"), "r")
        small = (
            large.join(root, F.col("a") == F.col("w"))
            .where("b <> r")
            .select(F.col("b").alias("a"), F.col("r").alias("b"))
            .union(root.select(F.col("w"), F.col("r")))
            .distinct()
        )
        now = materialize(small, "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
