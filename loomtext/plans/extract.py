"""Model stages over scenes and chapters, each a prompt, a cached answer and pure cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions import tolerant_json as J
from ..functions.text import clipped
from .models import Extractor, answers

ACT = "struct<type:string,channel:string,who:string,content:string,scope:array<string>>"
PERSON = "struct<name:string,role:string>"


def numbered(texts: Column, first: Column) -> Column:
    """Lines '[id] text' of an array of paragraphs."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (first + i).cast("string"), F.lit("] "), t)), "\n")


def scenes(spark: SparkSession, rows: DataFrame, model: Extractor, cache: str) -> DataFrame:
    """Records of scenes (scene_id, chapter_no, raw_text): who, where, acts, notes, status.

    Scenes without a usable answer are pending.
    """
    got = answers(spark, rows.select(F.col("scene_id").alias("id"), F.col("raw_text").alias("prompt")), "scene", model, cache)
    v = F.try_parse_json(J.as_object(F.col("answer")))
    people = clean.who(F.coalesce(F.try_variant_get(v, "$.who", f"array<{PERSON}>"), F.array().cast(f"array<{PERSON}>")))
    parsed = got.select("id", F.when(v.isNotNull(), "ok").otherwise("pending").alias("extract_status"), people.alias("_w"), v.alias("_v"))
    acts = F.coalesce(F.try_variant_get("_v", "$.actinfo", f"array<{ACT}>"), F.array().cast(f"array<{ACT}>"))
    acts = clean.valid_acts(acts, F.transform("_w", lambda p: p["name"]))
    out = parsed.withColumn("actinfo", acts)
    actors = F.transform(F.filter("actinfo", lambda a: a["type"] == "act"), lambda a: a["who"])
    out = out.select(
        F.col("id").alias("scene_id"),
        "extract_status",
        clean.with_actors(F.col("_w"), actors).alias("who"),
        clean.where_or_unknown(F.try_variant_get("_v", "$.where", "string")).alias("where"),
        "actinfo",
        F.coalesce(F.try_variant_get("_v", "$.notes", "string"), F.lit("")).alias("notes"),
    )
    return rows.join(out, "scene_id", "left").withColumn("extract_status", F.coalesce("extract_status", F.lit("pending")))


def merged_acts(records: DataFrame) -> DataFrame:
    """records with their acts merged down to a cap, the one sequential step of the cleaning."""

    @F.udf(f"array<{ACT}>", useArrow=True)
    def run(acts, length):
        return clean.merge_acts([a if isinstance(a, dict) else a.asDict() for a in acts or []], int(length or 0))

    return records.withColumn("actinfo", run("actinfo", F.length("raw_text")))


def registry(spark: SparkSession, by_chapter: DataFrame, model: Extractor, cache: str, *, scenes_max: int = 8, chars: int = 200, limit: int = 12, keys: Sequence[str] = ("chapter_no",)) -> DataFrame:
    """(keys, canonical, aliases, category) from (keys, texts), at most `limit` a chapter."""
    prompt = F.array_join(F.transform(F.slice("texts", 1, scenes_max), lambda t: clipped(t, chars)), "\n")
    got = answers(spark, by_chapter.select(F.struct(*keys).alias("id"), prompt.alias("prompt")), "registry", model, cache)
    items = F.slice(J.as_array(F.col("answer")), 1, limit)
    rows = got.select("id.*", F.explode(items).alias("v"))
    name = J.text_of(F.col("v"), ["canonical", "name"])
    out = rows.select(*keys, name.alias("canonical"), clean.list_items(J.texts_of(F.col("v"), "aliases"), 10).alias("aliases"), F.coalesce(J.text_of(F.col("v"), ["category", "type"]), F.lit("")).alias("category"))
    return out.where("canonical IS NOT NULL")


def settings(spark: SparkSession, rows: DataFrame, known: Sequence[str], model: Extractor, cache: str, *, chars: int = 1200, names: int = 50) -> DataFrame:
    """Setting deltas (scene, ord, name, category, definition, aliases) of scenes (scene_id, raw_text).

    All scenes see the same known names, so they are independent of each other.
    """
    head = F.lit("known: " + ", ".join(list(known)[:names]) + "\n")
    got = answers(spark, rows.select(F.col("scene_id").alias("id"), F.concat(head, clipped(F.col("raw_text"), chars)).alias("prompt")), "settings", model, cache)
    items = got.select(F.col("id").alias("scene"), F.posexplode(J.as_array(F.col("answer"))).alias("ord", "v"))
    return items.select(
        "scene",
        "ord",
        J.text_of(F.col("v"), ["name", "term"]).alias("name"),
        F.coalesce(J.text_of(F.col("v"), ["category", "type"]), F.lit("")).alias("category"),
        F.coalesce(J.text_of(F.col("v"), ["definition", "description"]), F.lit("")).alias("definition"),
        J.texts_of(F.col("v"), "aliases").alias("aliases"),
    ).where("name IS NOT NULL")


def summaries(spark: SparkSession, rows: DataFrame, stage: str, model: Extractor, cache: str, *, chars: int = 8000) -> DataFrame:
    """(id, summary, answer) of (id, text): outlines, resumes, reviews and the like."""
    got = answers(spark, rows.select("id", clipped(F.col("text"), chars).alias("prompt")), stage, model, cache)
    v = F.try_parse_json(J.as_object(F.col("answer")))
    wrapped = [F.try_variant_get(v, p, "string") for p in ("$.summary", "$.result.summary", "$.review.summary", "$.data.summary")]
    return got.select("id", F.coalesce(*wrapped, F.lit("")).alias("summary"), "answer")


def personality(spark: SparkSession, rows: DataFrame, dims: Sequence[str], model: Extractor, cache: str) -> DataFrame:
    """(name, dim, score) of (name, text), scores clamped to 0..100, 50 where unknown."""
    got = answers(spark, rows.select(F.col("name").alias("id"), F.col("text").alias("prompt")), "personality", model, cache)
    v = F.try_parse_json(J.as_object(F.col("answer")))
    scores = F.map_from_arrays(F.array(*map(F.lit, dims)), F.array(*[clean.score_0_100(F.coalesce(F.try_variant_get(v, f"$.dims.{d}", "string"), F.try_variant_get(v, f"$.{d}", "string"))) for d in dims]))
    return got.select(F.col("id").alias("name"), F.explode(scores).alias("dim", "score"))
