"""Reports over append-only logs: health, errors, tokens, progress, comparisons."""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks


def span(log: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last time, minutes between, and records."""
    return log.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).withColumn(
        "minutes", F.round((F.unix_timestamp("last") - F.unix_timestamp("first")) / 60, 2)
    )


def health(log: DataFrame, keys: Sequence[str], bad, *, limit: float = 0.15) -> DataFrame:
    """(keys, n, bad, rate, ok): the share of bad records and whether it is under the limit."""
    out = log.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    rate = F.round(F.col("bad") / F.greatest("n", F.lit(1)), 4)
    return out.withColumn("rate", rate).withColumn("ok", F.col("bad") / F.greatest("n", F.lit(1)) < limit)


def last_progress(log: DataFrame, step: str, ts: str, columns: Sequence[str], tie: str) -> DataFrame:
    """The last record of each step."""
    order = F.struct(ts, tie)
    return log.groupBy(step).agg(F.max(ts).alias(ts), *[F.max_by(c, order).alias(c) for c in columns])


def error_matrix(errors: DataFrame, task: str, kind: str, message: str, order: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(task, one count per kind, n, last): errors by task and kind with the last message."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    return errors.groupBy(task).agg(*counts, F.count("*").alias("n"), F.max_by(message, F.struct(*order)).alias("last"))


def token_ledger(usage: DataFrame, model: str = "model", prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """Totals by model, and over all models in the row named all."""
    out = usage.rollup(model).agg(F.sum(prompt).alias("prompt"), F.sum(completion).alias("completion"), F.count("*").alias("calls"), F.grouping(model).alias("_all"))
    return out.withColumn(model, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(model))).drop("_all")


def registry_stats(registry: DataFrame) -> DataFrame:
    """total, canonical, aliases, per_chapter of (chapter_no, canonical, aliases)."""
    names = registry.agg(F.count("*").alias("total"), F.countDistinct("canonical").alias("canonical"), F.countDistinct("chapter_no").alias("_c"))
    aliases = registry.select(F.explode("aliases").alias("a")).agg(F.countDistinct("a").alias("aliases"))
    return names.join(aliases).select("total", "canonical", "aliases", F.round(F.col("total") / F.greatest("_c", F.lit(1)), 2).alias("per_chapter"))


def jaccard(a: DataFrame, b: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """One row: distinct values in both, in either, and their ratio."""
    both = a.select(column).distinct().withColumn("_a", F.lit(1)).join(b.select(column).distinct().withColumn("_b", F.lit(1)), column, "full")
    out = both.agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("both"), F.count("*").alias("either"))
    return out.withColumn("jaccard", F.round(F.col("both") / F.greatest("either", F.lit(1)), digits))


def hit_rate(wanted: DataFrame, registry: DataFrame, *, block: int = 10_000) -> DataFrame:
    """wanted (name) with hit: a canonical name or alias contains it. Matched per element, in blocks of about `block` names."""
    names = registry.select(F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).distinct()
    asked = in_blocks(wanted.select("name").distinct(), "name", block)
    hits = reduce(DataFrame.union, [names.join(F.broadcast(part), F.contains("n", F.col("name"))).select("name").distinct() for part in asked])
    return wanted.join(hits.withColumn("hit", F.lit(True)), "name", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
