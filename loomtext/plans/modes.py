"""Further model stages: scene bounds, records with beats, knowledge, profiles, direct settings.

As in extract.py, each is a prompt table, a cached answer and a pure reading of it. Keys
hold the book, so chapters of one number in several books never mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import clean
from ..functions import tolerant_json as J
from ..functions.text import clipped
from ..operators import retrieval, segment
from .extract import PERSON, numbered
from .models import Extractor, answers

BEAT = "struct<beat:int,start:long,end:long,anchor:string,content:string>"
#: words by which an answer describes a point of view instead of naming a person; the
#: first ones are fixed by the language of the prompts
DESCRIBED = "人称|视角|主语|叙事者|narrator|(?i)pov"


def _ordered(rows: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """(keys, first, texts): the texts of a key in order, and the first position."""
    both = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col(text).alias("text"))))
    return rows.groupBy(*keys).agg(both.alias("p")).select(*keys, F.get("p", F.lit(0))["at"].alias("first"), F.transform("p", lambda x: x["text"]).alias("texts"))


def model_scenes(spark: SparkSession, paras: DataFrame, keys: Sequence[str], order: str, model: Extractor, cache: str, *, text: str = "text") -> DataFrame:
    """(keys, event_seq, start, end, size): scenes cut where the model sees new ones begin.

    paras are numbered without gaps within a key. The answer lists the scenes with their
    first paragraphs, or `starts` alone; blocks then get sizes within the limits. A chapter
    without a usable answer is one scene.
    """
    chapters = _ordered(paras, keys, order, text)
    prompts = chapters.select(F.struct(*keys, "first", F.size("texts").alias("n")).alias("id"), numbered(F.col("texts"), F.col("first")).alias("prompt"))
    got = answers(spark, prompts, "bounds", model, cache)
    listed = F.transform(J.as_array(F.col("answer"), ("scenes", "data", "result"), "start"), lambda v: F.try_variant_get(v, "$.start", "long"))
    plain = F.try_variant_get(F.try_parse_json(J.as_object(F.col("answer"))), "$.starts", "array<long>")
    starts = F.transform(F.filter(F.coalesce(plain, listed), lambda s: s.isNotNull()), lambda s: (s - F.col("id.first")).cast("int"))

    @F.udf("array<int>", useArrow=True)
    def ends(n, suggested):
        found = [int(s) for s in suggested] if suggested is not None else []
        return segment.normalise_bounds(int(n), found) if found else [int(n)]

    cut = got.select("id.*", ends("id.n", starts).alias("ends"))
    rows = cut.select(*keys, "first", "ends", F.posexplode("ends").alias("i", "stop"))
    begin = F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))
    return rows.select(
        *keys, (F.col("i") + 1).alias("event_seq"), (F.col("first") + begin).alias("start"), (F.col("first") + F.col("stop") - 1).alias("end"), (F.col("stop") - begin).cast("long").alias("size")
    )


def _text(v: Column, key: str) -> Column:
    return F.coalesce(F.btrim(F.try_variant_get(v, f"$.{key}", "string")), F.lit(""))


def _object(v: Column, key: str) -> Column:
    """A nested object as JSON text, {} where there is none."""
    got = F.to_json(F.try_variant_get(v, f"$.{key}", "variant"))
    return F.when(got.startswith("{"), got).otherwise("{}")


def _beats(texts, first, anchors, contents):
    """Beats with an anchor and a content, placed in the scene."""
    given = [(a.strip(), c.strip()) for a, c in zip(anchors or [], contents or []) if a and a.strip() and c and c.strip()]
    if not given:
        return []
    placed = segment.resolve_beats([t or "" for t in texts], [a for a, _ in given], int(first))
    return [{"beat": i + 1, "start": s, "end": e, "anchor": given[k][0], "content": given[k][1]} for i, (k, s, e) in enumerate(placed)]


def detailed_scenes(spark: SparkSession, rows: DataFrame, model: Extractor, cache: str, *, rounds: int = 2, described: str = DESCRIBED, rhetoric: int = 3, sentences: int = 3, least: int = 8, keywords: int = 8) -> DataFrame:
    """Full records of scenes (scene_id, first, texts[, prev_tail]), in two rounds or one.

    The first round asks who, what, when, where, why and how; the second, which sees the
    first answer, for the point of view, emotion, function, rhetoric, key sentences, summary,
    keywords and beats. One round asks for all. extract_status names the round that failed.
    """
    if rounds not in (1, 2):
        raise ValueError("rounds is 1 or 2")
    text = numbered(F.col("texts"), F.col("first"))
    if "prev_tail" in rows.columns:
        text = F.concat(F.when(F.coalesce("prev_tail", F.lit("")) != "", F.concat(F.lit("before: "), F.col("prev_tail"), F.lit("\n"))).otherwise(""), text)
    one = answers(spark, rows.select(F.col("scene_id").alias("id"), text.alias("prompt")), "record" if rounds == 1 else "round1", model, cache)
    one = one.select("id", "prompt", J.as_object(F.col("answer")).alias("a"))
    if rounds == 1:
        both = one.select("id", F.try_parse_json("a").alias("v"), F.try_parse_json("a").alias("w"))
        status = F.when(F.col("v").isNull(), "single_round_parse_fail").otherwise("ok")
    else:
        asked = one.where("a IS NOT NULL").select("id", F.concat("prompt", F.lit("\nround 1: "), "a").alias("prompt"))
        two = answers(spark, asked, "round2", model, cache).select("id", F.try_parse_json(J.as_object(F.col("answer"))).alias("w"))
        both = one.select("id", F.try_parse_json("a").alias("v")).join(two, "id", "left")
        status = F.when(F.col("v").isNull(), "round1_parse_fail").when(F.col("w").isNull(), "round2_parse_fail").otherwise("ok")
    v, w = F.col("v"), F.col("w")
    people = clean.who(F.coalesce(F.try_variant_get(v, "$.who", f"array<{PERSON}>"), F.array().cast(f"array<{PERSON}>")))
    beat = F.coalesce(F.try_variant_get(w, "$.beats", "array<struct<anchor:string,content:string>>"), F.array().cast("array<struct<anchor:string,content:string>>"))
    read = both.select(
        F.col("id").alias("scene_id"),
        status.alias("extract_status"),
        people.alias("who"),
        *[_text(v, k).alias(k) for k in ("what", "why", "how")],
        _object(v, "when").alias("when"),
        clean.where_or_unknown(F.try_variant_get(v, "$.where", "string")).alias("where"),
        clean.point_of_view(_text(w, "pov"), people, described).alias("pov"),
        _object(w, "emotion").alias("emotion"),
        *[_text(w, k).alias(k) for k in ("plot_function", "summary")],
        clean.list_items(J.texts_of(w, "rhetoric"), rhetoric).alias("rhetoric"),
        clean.list_items(J.texts_of(w, "key_sentences"), sentences, least).alias("key_sentences"),
        clean.list_items(J.texts_of(w, "keywords"), keywords).alias("keywords"),
        F.transform(beat, lambda b: b["anchor"]).alias("_a"),
        F.transform(beat, lambda b: b["content"]).alias("_c"),
    )
    return rows.join(read, "scene_id").withColumn("beats", F.udf(_beats, f"array<{BEAT}>", useArrow=True)("texts", "first", "_a", "_c")).drop("_a", "_c")


def beat_rows(records: DataFrame) -> DataFrame:
    """(scene_id, beat, start, end, anchor, content) of scenes that were read, for a table keyed by (scene_id, beat)."""
    return records.where("extract_status = 'ok'").select("scene_id", F.explode("beats").alias("b")).select("scene_id", "b.*")


def knowledge(spark: SparkSession, records: DataFrame, model: Extractor, cache: str, *, carry: Sequence[str] = ("book",)) -> DataFrame:
    """Entity deltas (carry, scene, name, category, aliases, four texts) for folds.entity_fold().

    Only scenes with people, acts or a place are asked about.
    """
    rows = records.where("extract_status = 'ok' AND (size(who) > 0 OR size(actinfo) > 0 OR coalesce(`where`, '') <> '')")
    parts = [
        F.concat(F.lit("chapter: "), F.col("chapter_no").cast("string")),
        F.concat(F.lit("scene: "), F.col("scene_id").cast("string")),
        F.concat(F.lit("who: "), clipped(F.to_json("who"), 800)),
        F.concat(F.lit("acts: "), clipped(F.to_json("actinfo"), 1500)),
        F.concat(F.lit("notes: "), clipped(F.coalesce("notes", F.lit("")), 300)),
        F.concat(F.lit("where: "), clean.where_or_unknown(F.col("where"))),
    ]
    prompts = rows.select(F.struct(*carry, F.col("scene_id").alias("scene")).alias("id"), F.concat_ws("\n", *parts).alias("prompt"))
    got = answers(spark, prompts, "knowledge", model, cache).select("id.*", F.explode(J.as_array(F.col("answer"))).alias("v"))
    texts = [_text(F.col("v"), t).alias(t) for t in ("description", "motivation", "persona", "psychology")]
    out = got.select(*carry, "scene", J.text_of(F.col("v"), ["name"]).alias("name"), _text(F.col("v"), "category").alias("category"), J.texts_of(F.col("v"), "aliases").alias("aliases"), *texts)
    return out.where("name IS NOT NULL")


def person_blocks(records: DataFrame, names: DataFrame, keys: Sequence[str] = ("book",), *, max_chapters: int = 8, max_chars: int = 3000) -> DataFrame:
    """(keys, name, chunk, text): the scenes of each name, by chapter, in blocks for one call each.

    A person is in a scene as one of its people or as an actor. names: (keys, name).
    """
    present = F.array_distinct(F.concat(F.transform("who", lambda p: p["name"]), F.filter(F.transform("actinfo", lambda a: a["who"]), lambda a: a.isNotNull())))
    rows = records.where("extract_status = 'ok'").select(*keys, "chapter_no", "scene_id", F.explode(present).alias("name"), retrieval.acts_text(F.col("actinfo"), F.col("where"), F.col("notes")).alias("line"))
    wanted = rows.join(names.select(*keys, "name").distinct(), [*keys, "name"], "left_semi")
    lines = F.array_sort(F.collect_list(F.struct("scene_id", "line")))
    chapters = wanted.groupBy(*keys, "name", "chapter_no").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text")).withColumn("chars", F.length("text").cast("long"))
    dealt = segment.chunk_by_budget(chapters, [*keys, "name"], "chapter_no", "chars", max_rows=max_chapters, max_size=max_chars)
    block = F.array_sort(F.collect_list(F.struct("chapter_no", "text")))
    return dealt.groupBy(*keys, "name", "chunk").agg(F.array_join(F.transform(block, lambda x: F.concat(F.lit("chapter "), x["chapter_no"].cast("string"), F.lit(":\n"), x["text"])), "\n").alias("text"))


def profiles(spark: SparkSession, records: DataFrame, names: DataFrame, model: Extractor, cache: str, *, keys: Sequence[str] = ("book",), others: int = 20, max_chapters: int = 8, max_chars: int = 3000) -> DataFrame:
    """(keys, name, aliases, identity, first_seen, events, relations, arc): a digest per block, then one merge of them.

    Names whose blocks, or whose merge, give no usable answer are left out. Events of later
    chapters than the book has go.
    """
    blocks = person_blocks(records, names, keys, max_chapters=max_chapters, max_chars=max_chars)
    asked = blocks.select(F.struct(*keys, "name", "chunk").alias("id"), F.concat(F.lit("person: "), F.col("name"), F.lit("\n"), F.col("text")).alias("prompt"))
    digests = answers(spark, asked, "profile-block", model, cache).select("id.*", J.as_object(F.col("answer")).alias("digest")).where("digest IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("chunk", "digest")))
    merged = digests.groupBy(*keys, "name").agg(F.array_join(F.transform(listed, lambda x: x["digest"]), ",").alias("digests"))
    cast = names.groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("cast"))
    rest = F.array_join(F.slice(F.array_remove(F.col("cast"), F.col("name")), 1, others), ", ")
    prompt = F.concat(F.lit("person: "), F.col("name"), F.lit("\ndigests: ["), F.col("digests"), F.lit("]\nothers: "), rest)
    got = answers(spark, merged.join(cast, list(keys)).select(F.struct(*keys, "name").alias("id"), prompt.alias("prompt")), "profile", model, cache)
    last = records.groupBy(*keys).agg(F.max("chapter_no").cast("int").alias("last"))
    read = got.select("id.*", F.try_parse_json(J.as_object(F.col("answer"))).alias("v")).where("v IS NOT NULL").join(last, list(keys))
    v = F.col("v")
    identity = F.coalesce(J.text_of(v, ["identity", "summary"]), F.lit(""))
    return read.select(
        *keys,
        F.coalesce(J.text_of(v, ["name"]), F.col("name")).alias("name"),
        clean.list_items(J.texts_of(v, "aliases"), 10).alias("aliases"),
        identity.alias("identity"),
        clean.first_seen_within(F.coalesce(F.try_variant_get(v, "$.first_seen", "int"), F.lit(0)), F.col("last")).alias("first_seen"),
        clean.list_items(clean.within_chapters(J.texts_of(v, "events"), F.col("last")), 8).alias("events"),
        clean.list_items(J.texts_of(v, "relations"), 8).alias("relations"),
        _text(v, "arc").alias("arc"),
    )


def direct_settings(spark: SparkSession, streams: DataFrame, model: Extractor, cache: str, *, keys: Sequence[str] = ("book",), batch: int = 5) -> DataFrame:
    """(keys, name, type, description, first_seen, related) from chapter texts (keys, chapter_no, text), the first of a name.

    Chapters go in runs of `batch`; a run without usable entries is asked once more.
    """
    line = F.concat(F.lit("chapter "), F.col("chapter_no").cast("string"), F.lit(":\n"), F.col("text"))
    dealt = segment.batches(streams.withColumn("line", line), keys, ["chapter_no"], batch)
    runs = dealt.groupBy(*keys, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
    prompts = runs.select(F.struct(*keys, "batch").alias("id"), "prompt")

    def read(rows: DataFrame, stage: str) -> DataFrame:
        got = answers(spark, rows, stage, model, cache)
        items = J.as_array(F.col("answer"), ("settings", "data", "result", "terms", "items"))
        return got.select("id", "prompt", F.filter(items, lambda v: J.text_of(v, ["name", "名称", "设定名"]).isNotNull()).alias("items"))

    first = read(prompts, "direct-settings")
    again = read(first.where("size(items) = 0").select("id", "prompt"), "direct-settings-again")
    entries = first.where("size(items) > 0").unionByName(again).select("id.*", F.posexplode("items").alias("pos", "v"))
    v = F.col("v")
    fields = entries.select(
        *keys,
        "batch",
        "pos",
        J.text_of(v, ["name", "名称", "设定名"]).alias("name"),
        _text(v, "type").alias("type"),
        _text(v, "description").alias("description"),
        F.try_variant_get(v, "$.first_seen", "int").alias("first_seen"),
        J.texts_of(v, "related").alias("related"),
    )
    nth = W.partitionBy(*keys, "name").orderBy("batch", "pos")
    return fields.withColumn("_k", F.row_number().over(nth)).where("_k = 1").drop("_k", "batch", "pos")
