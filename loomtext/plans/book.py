"""The book pipeline: texts to paragraphs, scenes, records, entities, graphs and products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.clean import UNKNOWN
from ..operators import audit, characters, entities, folds, graphs, retrieval, segment, style
from ..sources import novel
from . import extract, modes, products
from .models import Extractor, Offline
from .runner import Runner


def build_runner(spark: SparkSession, folder: str, source: str, *, model: Extractor | None = None, chapter: str = novel.CHAPTER, volume: str = novel.VOLUME, max_chapters: int | None = None, signals: tuple[str, ...] = (), bounds: str = "rules", rounds: int = 2) -> Runner:
    """A runner with all modules for the texts at `source`; products are tables in `folder`.

    Scene numbers are dense within a book; the scene_id joins book and number. Scenes are cut
    by rules, or by the model where bounds is "model"; `rounds` is how many calls a scene's
    detailed record takes.
    """
    if bounds not in ("rules", "model"):
        raise ValueError(f"bounds are rules or model, not {bounds}")
    model = model or Offline()
    cache = f"{folder}/_answers"
    r = Runner(spark, folder)

    def lines(spark, _):
        return novel.numbered_lines(novel.ingest(spark, source), chapter=chapter, volume=volume, max_chapters=max_chapters)

    def scenes(spark, t):
        paras = t["paragraphs"].where("chapter_no > 0")
        if bounds == "model":
            return with_texts(paras, modes.model_scenes(spark, paras, ["book", "chapter_no"], "para_id", model, cache))
        broken = segment.rule_breaks(paras, ["book", "chapter_no"], "para_id", style.X.is_dialogue(F.col("text"), style.X.CJK), signals)
        broken = broken.withColumn("switch", style.X.starts_with_any(F.col("text"), signals) if signals else F.lit(False))
        return with_texts(paras, segment.pack_scenes(broken, ["book", "chapter_no"], "para_id", switch="switch"))

    def with_texts(paras, packed):
        texts = segment.rows_in_scenes(paras, packed, ["book", "chapter_no"], "para_id")
        raw = segment.raw_texts(texts, ["book", "chapter_no", "event_seq"], "para_id")
        out = packed.join(raw, ["book", "chapter_no", "event_seq"])
        return out.withColumn("scene_id", F.concat_ws("#", "book", F.format_string("%06d", "chapter_no"), F.format_string("%04d", "event_seq")))

    def coverage(_, t):
        spans = t["scenes"].select("book", F.explode(F.sequence("start", "end")).alias("para_id"))
        keys = ["book", "para_id"]
        audit.assert_covered(t["paragraphs"], keys, spans, novel.preamble(t["paragraphs"]))
        return audit.table_counts(paragraphs=t["paragraphs"], scenes=t["scenes"])

    def acts(_, t):
        rows = t["records"].where("extract_status = 'ok'").select(F.col("chapter_no").alias("chapter"), F.col("scene_id").alias("scene"), F.posexplode("actinfo").alias("pos", "a"))
        return rows.where("a.type = 'act'").select("chapter", "scene", "pos", "a.who", "a.channel", "a.content")

    def people(_, t):
        return t["records"].select(F.col("scene_id").alias("scene"), F.col("chapter_no").alias("chapter"), F.explode("who.name").alias("name")).distinct()

    def registry(spark, t):
        texts = t["scenes"].groupBy("book", "chapter_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("scene_id", "raw_text"))), lambda x: x["raw_text"]).alias("texts"))
        return extract.registry(spark, texts, model, cache, keys=("book", "chapter_no"))

    def detailed(spark, t):
        """Records with beats, of scenes whose paragraphs are told apart by line feeds."""
        rows = segment.previous_tail(t["scenes"], ["book"], ["chapter_no", "event_seq"], "raw_text")
        rows = rows.select("book", "chapter_no", "scene_id", F.col("start").alias("first"), F.split("raw_text", "\n").alias("texts"), "prev_tail")
        return modes.detailed_scenes(spark, rows, model, cache, rounds=rounds)

    def cast(t):
        counts = t["records"].select("book", "scene_id", F.explode("who.name").alias("name")).distinct().groupBy("book", "name").agg(F.count("*").alias("n")).where("n >= 3")
        nth = F.row_number().over(W.partitionBy("book").orderBy(F.desc("n"), "name"))
        return counts.withColumn("k", nth).where("k <= 30").select("book", "name")

    def direct(spark, t):
        return modes.direct_settings(spark, products.act_stream(t["records"], ("book", "chapter_no")), model, cache)

    def characters_(_, t):
        names = t["people"].groupBy("name").agg(F.min("chapter").cast("long").alias("first_seen"))
        known = names.join(entities.alias_union(t["registry"]), "name", "left")
        known = known.select("name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "first_seen", F.lit("").alias("description"), F.xxhash64("name").alias("ord"))
        return entities.merge_entities(known, entities.mutual_edges(entities.alias_union(t["registry"]), known))

    def settings(spark, t):
        deltas = extract.settings(spark, t["scenes"].select("scene_id", "raw_text"), [], model, cache)
        return folds.settings_fold(deltas)

    def search(_, t):
        docs = t["records"].where("extract_status = 'ok'").select("scene_id", retrieval.search_text(F.col("actinfo"), F.col("raw_text")).alias("text"))
        return retrieval.build_index(docs, "scene_id", "text")[0]

    def detail(_, t):
        """One JSON document a section: what a page of the book needs."""

        def section(name: str, df: DataFrame) -> DataFrame:
            item = F.to_json(F.struct(*df.columns))
            return df.groupBy().agg(F.lit(name).alias("section"), F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]")).alias("json"))

        records, chapter = t["records"], ["book", "chapter_no"]
        texts = t["paragraphs"].where("chapter_no > 0")
        events = t["profiles"].select("book", F.col("name").alias("who"), F.explode("events").alias("text"))
        events = events.withColumn("chapter_no", F.regexp_extract("text", "^第([0-9]+)", 1).try_cast("int")).where("chapter_no IS NOT NULL")
        nodes, edges = graphs.truncated(graphs.weighted_nodes(graphs.nodes(t["people"]), t["edges"]), t["edges"])
        sections = {
            "book": t["chapters"].groupBy("book").agg(F.count("*").alias("chapters")),
            "chapters": t["chapters"].select("book", "chapter_no", "title"),
            "timeline": events.groupBy(*chapter).agg(F.array_sort(F.collect_list(F.struct("text", "who"))).alias("events")),
            "outlines": t["outlines"],
            "tags": new_names(records, t["settings"]),
            "characters": characters.top_characters(t["facts"]).select("name", F.size("appearances").alias("n")),
            "nodes": nodes,
            "edges": edges,
            "settings": characters.top_settings(t["settings"]).select("name", "category", "definition"),
            "style": t["sentences"],
            "chapter_style": style.sentence_stats(texts, chapter, style.X.CJK),
        }
        return reduce(DataFrame.unionByName, [section(name, df) for name, df in sections.items()])

    def new_names(records, terms):
        """(book, chapter_no, kind, names): the people, places and settings that a chapter is the first to have."""
        people = records.select("book", "chapter_no", F.lit("people").alias("kind"), F.explode("who.name").alias("name"))
        places = records.where(F.col("where") != UNKNOWN).select("book", "chapter_no", F.lit("places").alias("kind"), F.col("where").alias("name"))
        found = terms.select(F.col("name"), F.explode("source_scenes").alias("scene_id")).join(records.select("scene_id", "book", "chapter_no"), "scene_id")
        rows = people.union(places).union(found.select("book", "chapter_no", F.lit("settings").alias("kind"), "name"))
        first = rows.groupBy("book", "kind", "name").agg(F.min("chapter_no").alias("chapter_no"))
        return first.groupBy("book", "chapter_no", "kind").agg(F.array_sort(F.collect_list("name")).alias("names"))

    r.add("lines", lines)
    r.add("paragraphs", lambda _, t: novel.paragraphs(t["lines"]), ["lines"])
    r.add("chapters", lambda _, t: novel.chapters(t["lines"], t["paragraphs"]), ["lines", "paragraphs"])
    r.add("scenes", scenes, ["paragraphs"])
    r.add("coverage", coverage, ["paragraphs", "scenes"])
    r.add("records", lambda s, t: extract.merged_acts(extract.scenes(s, t["scenes"], model, cache)), ["scenes", "coverage"])
    r.add("acts", acts, ["records"])
    r.add("people", people, ["records"])
    r.add("facts", lambda _, t: characters.facts(t["acts"], t["people"]), ["acts", "people"])
    r.add("registry", registry, ["scenes", "records"])
    r.add("entities", characters_, ["people", "registry"])
    r.add("settings", settings, ["scenes", "registry"])
    r.add("detailed", detailed, ["scenes", "coverage"])
    r.add("beats", lambda _, t: modes.beat_rows(t["detailed"]), ["detailed"])
    r.add("knowledge", lambda s, t: folds.entity_fold(modes.knowledge(s, t["records"], model, cache), ["book"]), ["records"])
    r.add("profiles", lambda s, t: modes.profiles(s, t["records"], cast(t), model, cache), ["records"])
    r.add("direct_settings", direct, ["records"])
    r.add("outlines", lambda s, t: products.outlines(s, t["records"], model, cache, keys=("book", "chapter_no")), ["records"])
    r.add("edges", lambda _, t: graphs.cooccurrence(t["people"], "scene", "name", least=2), ["people"])
    r.add("sentences", lambda _, t: style.sentence_stats(t["paragraphs"], ["book"], style.X.CJK), ["paragraphs"])
    r.add("words", lambda _, t: style.gram_words(t["paragraphs"], ["book"], (4, 3, 2), 5), ["paragraphs"])
    r.add("postings", search, ["records"])
    r.add("detail", detail, ["paragraphs", "chapters", "records", "people", "facts", "edges", "settings", "sentences", "outlines", "profiles"])
    return r
