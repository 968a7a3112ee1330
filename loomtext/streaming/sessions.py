"""Activity sessions over an event stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import _source, run_to_end


def sessions(events: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """(user_id, session, events): sessions of a user, closed by a pause of `gap`.

    Events later than `late` behind the newest one are dropped, as the watermark says.
    """
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("events"))


def replay(spark: SparkSession, path: str, gap: str) -> DataFrame:
    """The sessions of all files of a path, streamed to the end.

    Closed and open sessions come out as of the last batch, with a watermark that covers
    the whole replay, so that no event is late.
    """
    schema = spark.read.parquet(path).schema
    source = _source(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))  # event time has a zone
    rows = sessions(source, gap, "3650 days")
    out = run_to_end(spark, rows, "complete")
    return out.select("user_id", F.unix_timestamp("session.start").alias("started"), "events")
