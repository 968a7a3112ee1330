"""Connected components over an edge table, for entity resolution."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir, else one in the warehouse, or a temporary one in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    return f"file://{tempfile.mkdtemp(prefix='loomtext-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def _checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the least node that it reaches.

    Each round takes the least label among neighbours and then follows labels of labels,
    so long chains settle in a number of rounds that grows with the logarithm of their
    length. Rounds are checkpointed in the shared folder.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = _checkpointed(both)
    now = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = now.join(near.select(F.col("a").alias("node"), "near"), "node", "left")
        step = step.select("node", "root", F.least("root", F.coalesce("near", "root")).alias("to"))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        after = step.join(jump, "to", "left").select("node", F.col("root").alias("old"), F.least("to", F.coalesce("next", "to")).alias("root"))
        after = _checkpointed(after)
        changed = not after.where("old <> root").isEmpty()
        now = after.select("node", "root")
        if not changed:
            return now
