"""The token ledger as a stream: counts by model that grow with an append-only log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_root


def totals(usage: DataFrame) -> DataFrame:
    """Running totals by model of (model, prompt); complete or update output mode."""
    return usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """All files of a path as a stream, to the end; returns the final totals."""
    schema = spark.read.parquet(path).schema
    source = _source(spark, path, schema)
    usage = source.select(F.col("event_type").alias("model"), (F.col("event_id") % 7).alias("prompt"))
    return run_to_end(spark, totals(usage), "complete")


def _source(spark: SparkSession, path: str, schema) -> DataFrame:
    # a file source takes a folder or a pattern; a trailing * matches one file as well
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path + "*")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The result of the last batch, as the executors have written it: none of it goes through the driver.

    In complete mode every batch has the whole result, so only the newest folder stays.
    """
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    written: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{root}/batch-{number}"
        batch.write.mode("overwrite").parquet(folder)
        old, written[:] = [x for x in written if x != folder], [folder]
        for x in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:  # no file, no batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(written[0])
