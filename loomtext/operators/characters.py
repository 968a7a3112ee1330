"""Character facts from acts, and what is backfilled from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def _last_texts(acts: DataFrame, name: str, n: int, chars: int) -> DataFrame:
    rows = last_n(acts, ["who"], ["chapter", "scene", "pos"], n)
    item = F.struct("chapter", "scene", "pos", F.substring("content", 1, chars).alias("content"))
    return rows.groupBy("who").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["content"]).alias(name))


def facts(acts: DataFrame, people: DataFrame, *, keep: int = 12, chars: int = 80, partners: int = 8) -> DataFrame:
    """Facts per character from acts (chapter, scene, pos, who, channel, content).

    people: (scene, name). appearances come from acts only; the last sayings and the last
    doings (all other channels) are cut to a length; partners are the names met most over
    acts. Names that only stand in people get an empty row.
    """
    from .graphs import directed_cooccurrence

    did = acts.where("who IS NOT NULL AND who <> ''")
    seen = did.groupBy("who").agg(F.array_sort(F.collect_set(F.struct("chapter", "scene"))).alias("appearances"))
    said = _last_texts(did.where("channel = 'say'"), "sayings", keep, chars)
    done = _last_texts(did.where("channel <> 'say'"), "doings", keep, chars)
    met = directed_cooccurrence(did, people, "scene", "who", "name", best=partners)
    order = W.partitionBy("actor").orderBy(F.desc("acts"), "other")
    top = met.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= partners)
    with_ = top.groupBy(F.col("actor").alias("who")).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_k", "other", "acts"))), lambda x: F.struct(x["other"], x["acts"]))).alias("co_occurrences"))
    names = people.select(F.col("name").alias("who")).union(did.select("who")).where("who <> ''").distinct()
    out = names.join(seen, "who", "left").join(said, "who", "left").join(done, "who", "left").join(with_, "who", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("who").alias("name"),
        F.coalesce("appearances", F.array().cast(seen.schema["appearances"].dataType)).alias("appearances"),
        F.coalesce("sayings", none).alias("sayings"),
        F.coalesce("doings", none).alias("doings"),
        F.coalesce("co_occurrences", F.create_map().cast("map<string,bigint>")).alias("co_occurrences"),
    )


def eligible(fact_rows: DataFrame, clues: DataFrame, least: int = 2) -> DataFrame:
    """Characters with enough appearances, or with evidence of their own (a table with name)."""
    marked = fact_rows.join(clues.select("name").distinct().withColumn("_c", F.lit(True)), "name", "left")
    return marked.where((F.size("appearances") >= least) | F.col("_c")).drop("_c")


def evidence_index(clues: DataFrame) -> DataFrame:
    """(name, texts): evidence (names, text, ord) by entity, in order."""
    rows = clues.select(F.explode("names").alias("name"), "ord", "text")
    return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))


def top_characters(fact_rows: DataFrame, top: int = 80, resumed: DataFrame | None = None, least: int = 5) -> DataFrame:
    """The top characters by appearances, and resumed ones with at least `least`."""
    ranked = fact_rows.withColumn("n", F.size("appearances"))
    out = ranked.orderBy(F.desc("n"), "name").limit(top)
    if resumed is not None:
        out = out.union(ranked.where(F.col("n") >= least).join(resumed.select("name"), "name", "left_semi")).distinct()
    return out.drop("n")


def top_settings(terms: DataFrame, top: int = 800) -> DataFrame:
    return terms.withColumn("_n", F.size("source_scenes")).orderBy(F.desc("_n"), "name").limit(top).drop("_n")


def profiles(fact_rows: DataFrame, resumes: DataFrame, aliases: DataFrame, *, partners: int = 8, events: int = 5) -> DataFrame:
    """Character profiles: resumes where there are any, else what the facts give.

    resumes: (name, identity, events, relations, arc); aliases: (name, aliases). Missing
    relations become the partners met most, missing events the first doings.
    """
    none = F.array().cast("array<string>")
    by_partner = F.transform(F.slice(F.map_entries("co_occurrences"), 1, partners), lambda e: F.concat(F.lit("与"), e["key"], F.lit(": "), e["value"].cast("string")))
    rows = fact_rows.join(resumes, "name", "left").join(aliases, "name", "left")
    return rows.select(
        "name",
        F.coalesce("aliases", none).alias("aliases"),
        F.coalesce("identity", F.lit("")).alias("identity"),
        F.array_min(F.transform("appearances", lambda a: a["chapter"])).alias("first_chapter"),
        F.when(F.size("events") > 0, F.col("events")).otherwise(F.slice("doings", 1, events)).alias("events"),
        F.when(F.size("relations") > 0, F.col("relations")).otherwise(by_partner).alias("relations"),
        F.coalesce("arc", F.lit("")).alias("arc"),
    )


def activity(rows: DataFrame, now: int, *, recent: int = 30, often: int = 3, weight: float = 4, confirmed: int = 2) -> DataFrame:
    """rows (last, times, weight, confirmed) with active: recent, frequent, heavy or confirmed."""
    rule = (F.lit(now) - F.col("last") <= recent) | (F.col("times") >= often) | (F.col("weight") >= weight) | (F.col("confirmed") >= confirmed)
    return rows.withColumn("active", F.coalesce(rule, F.lit(False)))
