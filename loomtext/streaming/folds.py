"""Incremental folds over growing inputs, by micro-batch and by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.router import Thresholds
from ..sources.sinks import upsert


def settings_upsert(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str):
    """Keep the last version of each key in a Parquet table while deltas stream in."""

    def batch(rows: DataFrame, number: int) -> None:
        upsert(rows.sparkSession, rows, path, keys, version)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def baseline_append(stream: DataFrame, path: str, checkpoint: str):
    """Append the metrics of new books to the ledger that baseline() averages."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = T.StructType([T.StructField(c, T.LongType()) for c in ("hit", "gap", "unknown", "definition", "meme")] + [T.StructField("rule", T.StringType())])


def route(stream: DataFrame, key: str, order: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """(key, order, rule) once per key, when any router rule first fires; sticky after that.

    stream: key, order, is_hit, is_unknown, is_definition, is_meme, gap_size. Rows of a
    micro-batch are taken in order; a key's state is five counters.
    """
    out = f"{key} {stream.schema[key].dataType.simpleString()}, {order} {stream.schema[order].dataType.simpleString()}, rule string"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hit, gap, unknown, definition, meme, rule = state.get if state.exists else (0, 0, 0, 0, 0, None)
        found = None
        for row in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            if rule:
                break
            hit, unknown = hit + int(row.is_hit), unknown + int(row.is_unknown)
            definition, meme, gap = definition + int(row.is_definition), meme + int(row.is_meme), max(gap, int(row.gap_size))
            for name, value, limit in (("R1", hit, limits.hits), ("R3", gap, limits.gaps), ("R2", unknown, limits.unknown), ("R4", definition, limits.definitions), ("R5", meme, limits.memes)):
                if value >= limit:
                    rule, found = name, getattr(row, order)
                    break
        state.update((hit, gap, unknown, definition, meme, rule))
        if found is not None:
            yield pd.DataFrame({key: [k[0]], order: [found], "rule": [rule]})

    columns = [key, order, "is_hit", "is_unknown", "is_definition", "is_meme", "gap_size"]
    return stream.select(*columns).groupBy(key).applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.NoTimeout)


def latest(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    from ..sources.tables import latest_by_key

    return latest_by_key(spark.read.option("mergeSchema", "true").parquet(path), keys, version).where(F.lit(True))
