"""The knowledge router: rules over an ordered sequence of observed terms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    hits: int = 3
    gaps: int = 2
    unknown: int = 8
    definitions: int = 3
    memes: int = 2


#: The forms of names that count as slang, each over a whole name.
MEMES = (
    r"[A-Za-z]{2,8}",
    r".*(梗|玩梗|名场面|名台词|老梗|烂梗)",
    r"(退婚|废柴|扮猪|打脸|迪化|狗粮|发糖|虐心|毒点|爽点|金手指)",
    r".*(套路|操作|骚操作|神展开|反套路)",
)


def looks_like_meme(name: Column, patterns: Sequence[str] = MEMES) -> Column:
    """One of the patterns matches the whole name."""
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(f"^(?:{p})$")
    return out


def running_counts(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows (is_hit, is_unknown, is_definition, is_meme, gap_size) with counts so far."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows
    for c in ("hit", "unknown", "definition", "meme"):
        out = out.withColumn(f"n_{c}", F.sum(F.col(f"is_{c}").cast("int")).over(w))
    return out.withColumn("n_gap", F.max("gap_size").over(w))


def decisions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limits: Thresholds = Thresholds()) -> DataFrame:
    """(keys, order..., rule) of the first row per key at which any rule fires; sticky from there on.

    Rules are checked in order: hits, gaps, unknown terms, definitions, memes.
    """
    counted = running_counts(rows, keys, order)
    rule = (
        F.when(F.col("n_hit") >= limits.hits, "R1")
        .when(F.col("n_gap") >= limits.gaps, "R3")
        .when(F.col("n_unknown") >= limits.unknown, "R2")
        .when(F.col("n_definition") >= limits.definitions, "R4")
        .when(F.col("n_meme") >= limits.memes, "R5")
    )
    fired = counted.withColumn("rule", rule).where("rule IS NOT NULL")
    first = W.partitionBy(*keys).orderBy(*order)
    return fired.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*keys, *order, "rule")


def search_external(queries: DataFrame, local: DataFrame, lexicon_hits: DataFrame) -> DataFrame:
    """(query, layer, answer): a local term exactly, else lexicon hits, else nothing (layer 0).

    local: (name, definition); lexicon_hits: from layered_search().
    """
    best = lexicon_hits.where("rank <= 5").groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("_l2"))
    known = local.select(F.col("name").alias("query"), F.col("definition").alias("_l1")).dropDuplicates(["query"])
    rows = queries.join(known, "query", "left").join(best, "query", "left")
    layer = F.when(F.col("_l1").isNotNull(), 1).when(F.col("_l2").isNotNull(), 2).otherwise(0)
    return rows.select("query", layer.alias("layer"), F.coalesce("_l1", "_l2", F.lit("")).alias("answer"))
