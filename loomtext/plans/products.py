"""Products on top of the book tables: outlines, profiles, reviews, answers, reports, pages.

Each model stage is a prompt table for answers(), and a pure reading of what comes back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions import tolerant_json as J
from ..functions.text import clipped
from ..operators import characters, graphs, retrieval, runlog, segment
from ..sources.sinks import markdown_table, render_page
from .extract import summaries
from .models import Extractor, answers


def act_stream(records: DataFrame, keys: Sequence[str] = ("chapter_no",)) -> DataFrame:
    """(keys, text): the acts of a chapter as lines, scene by scene."""
    line = retrieval.acts_text(F.col("actinfo"), F.col("where"), F.col("notes"))
    rows = F.array_sort(F.collect_list(F.struct("scene_id", line.alias("line"))))
    return records.where("extract_status = 'ok'").groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def outlines(spark: SparkSession, records: DataFrame, model: Extractor, cache: str, *, chars: int = 8000, keys: Sequence[str] = ("chapter_no",)) -> DataFrame:
    """(keys, summary): one outline a chapter."""
    rows = act_stream(records, keys).select(F.struct(*keys).alias("id"), "text")
    return summaries(spark, rows, "outline", model, cache, chars=chars).select("id.*", "summary")


def book_summary(spark: SparkSession, outline_rows: DataFrame, model: Extractor, cache: str, *, chars: int = 8000) -> DataFrame:
    """One summary over the outlines in order, cut to a budget."""
    ordered = F.array_sort(F.collect_list(F.struct("chapter_no", "summary")))
    text = F.array_join(F.transform(ordered, lambda x: F.format_string("%d: %s", x["chapter_no"], x["summary"])), "\n")
    rows = outline_rows.groupBy().agg(text.alias("text")).select(F.lit("book").alias("id"), "text")
    return summaries(spark, rows, "summary", model, cache, chars=chars).select("summary")


def frequent_names(people: DataFrame, least: int = 3, top: int = 30) -> DataFrame:
    """(name, n): the names in most scenes."""
    return people.groupBy("name").agg(F.countDistinct("scene").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(top)


def character_blocks(records: DataFrame, *, max_chapters: int = 8, max_chars: int = 3000) -> DataFrame:
    """(chapter_no, text, chars, chunk): chapters packed into blocks for one call each."""
    rows = act_stream(records).withColumn("chars", F.length("text").cast("long")).withColumn("book", F.lit(0))
    return segment.chunk_by_budget(rows, ["book"], "chapter_no", "chars", max_rows=max_chapters, max_size=max_chars)


def resumes(spark: SparkSession, facts: DataFrame, clues: DataFrame, model: Extractor, cache: str, *, sayings: int = 5, doings: int = 5, evidence: int = 3) -> DataFrame:
    """(name, identity, events, relations, arc) of eligible characters, from their facts and evidence."""
    rows = characters.eligible(facts, clues).join(characters.evidence_index(clues), "name", "left") if "names" in clues.columns else characters.eligible(facts, clues).withColumn("texts", F.array().cast("array<string>"))
    parts = [F.concat(F.lit("name: "), F.col("name")), F.array_join(F.slice("sayings", 1, sayings), "\n"), F.array_join(F.slice("doings", 1, doings), "\n"), F.array_join(F.slice(F.coalesce("texts", F.array().cast("array<string>")), 1, evidence), "\n")]
    got = answers(spark, rows.select(F.col("name").alias("id"), F.concat_ws("\n", *parts).alias("prompt")), "resume", model, cache)
    v = F.try_parse_json(J.as_object(F.col("answer")))
    return got.select(
        F.col("id").alias("name"),
        F.coalesce(F.try_variant_get(v, "$.identity", "string"), F.try_variant_get(v, "$.summary", "string"), F.lit("")).alias("identity"),
        clean.list_items(J.texts_of(v, "events"), 5).alias("events"),
        clean.list_items(J.texts_of(v, "relations"), 8).alias("relations"),
        F.coalesce(F.try_variant_get(v, "$.arc", "string"), F.lit("")).alias("arc"),
    )


def strengthen(spark: SparkSession, terms: DataFrame, model: Extractor, cache: str, *, top: int = 30) -> DataFrame:
    """One answer about the most used terms: what is missing, doubtful or connected."""
    rows = characters.top_settings(terms, top).select(F.concat_ws(": ", "name", "definition").alias("line"))
    text = rows.groupBy().agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text")).select(F.lit("terms").alias("id"), "text")
    return summaries(spark, text, "strengthen", model, cache)


def reviews(spark: SparkSession, blocks: dict[str, str], model: Extractor, cache: str, *, chars: int = 4000) -> DataFrame:
    """(block, summary): an editor's review of each named block of text."""
    rows = spark.createDataFrame(sorted(blocks.items()), "id string, text string")
    return summaries(spark, rows, "review", model, cache, chars=chars).select(F.col("id").alias("block"), "summary")


def answer(spark: SparkSession, hits: DataFrame, scenes: DataFrame, question: str, model: Extractor, cache: str, *, key: str = "scene_id", text: str = "raw_text", chapter: str = "chapter_no") -> DataFrame:
    """(question, context, answer) from the hits of a search, material only."""
    context = retrieval.rag_context(hits, scenes, key, text, chapter)
    prompt = F.concat(F.lit("Answer from this material only.\n"), F.col("context"), F.lit(f"\nQuestion: {question}"))
    rows = context.select(F.lit(question).alias("id"), prompt.alias("prompt"))
    got = answers(spark, rows, "answer", model, cache)
    return got.select(F.col("id").alias("question"), "answer").crossJoin(context)  # one row each


def define(spark: SparkSession, term: str, terms: DataFrame, scenes: DataFrame, columns: Sequence[str], model: Extractor, cache: str, *, doubt: float = 0.5) -> DataFrame:
    """(term, definition, source): the graph's definition, else one from scenes that mention it.

    More doubt reads more scenes: 2, 4 or 6.
    """
    known = terms.where((F.col("name") == term) | F.array_contains("aliases", term)).where("definition <> ''").select(F.lit(term).alias("term"), "definition", F.lit("graph").alias("source")).limit(1)
    if not known.isEmpty():
        return known
    limit = 2 if doubt < 0.4 else 4 if doubt < 0.8 else 6
    context = retrieval.context_for_term(scenes, term, columns, order=["scene_id"], limit=limit)
    text = context.groupBy().agg(F.array_join(F.flatten(F.array_sort(F.collect_list("blobs"))), "\n").alias("text"))
    got = summaries(spark, text.select(F.lit(term).alias("id"), "text"), "define", model, cache)
    return got.select(F.col("id").alias("term"), F.col("summary").alias("definition"), F.lit("context").alias("source"))


def prompt_block(registry: DataFrame, chapter: int, *, limit: int = 15, aliases: int = 3) -> DataFrame:
    """(chapter_no, block): the chapter's entities as lines for a prompt."""
    line = F.concat("canonical", F.when(F.size("aliases") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("aliases", 1, aliases), ", "), F.lit(")"))).otherwise(""))
    rows = registry.where(F.col("chapter_no") == chapter)
    return rows.groupBy("chapter_no").agg(F.array_join(F.slice(F.array_sort(F.collect_list(line)), 1, limit), "\n").alias("block"))


def comparison(spark: SparkSession, runs: dict[str, DataFrame], wanted: DataFrame) -> str:
    """A Markdown report of registries side by side: sizes, hits, overlap of canonical names."""
    parts = ["# Comparison\n"]
    for name, registry in runs.items():
        hits = runlog.hit_rate(wanted, registry).agg(F.count_if("hit").alias("hits"), F.count("*").alias("of"))
        parts += [f"## {name}\n", markdown_table(runlog.registry_stats(registry).join(hits))]
    names = list(runs)
    for a, b in zip(names, names[1:]):
        parts += [f"## {a} and {b}\n", markdown_table(runlog.jaccard(runs[a], runs[b], "canonical"))]
    return "\n".join(parts)


def log_report(log: DataFrame, *, empty_limit: float = 0.15, least_terms: int = 300, most_share: float = 0.3) -> DataFrame:
    """(check, value, ok) of a run log: empty answers, terms found, share of failed steps."""
    gauges = log.where("name IS NOT NULL").groupBy("name").agg(F.max_by("value", "ts").alias("value"))
    total = log.agg(F.count("*").alias("n"), F.count_if(F.col("level") == "ERROR").alias("bad"))
    failed = total.select(F.lit("errors").alias("check"), F.round(F.col("bad") / F.greatest("n", F.lit(1)), 4).alias("value")).withColumn("ok", F.col("value") <= most_share)
    rules: dict[str, Column] = {"empty_rate": F.col("value") < empty_limit, "terms": F.col("value") >= least_terms}
    out = failed
    for name, ok in rules.items():
        out = out.unionByName(gauges.where(F.col("name") == name).select(F.col("name").alias("check"), "value", ok.alias("ok")))
    return out


def panel(log: DataFrame) -> DataFrame:
    """(step, done, total, bar, left): the last progress of each step of a run log."""
    from ..functions.text import progress_bar, time_left

    rows = log.where("total IS NOT NULL")
    span = rows.groupBy("step").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("done", "ts").alias("done"), F.max_by("total", "ts").alias("total"))
    elapsed = F.unix_timestamp("last") - F.unix_timestamp("first")
    return span.select("step", "done", "total", progress_bar(F.col("done"), F.col("total")).alias("bar"), F.round(time_left(F.col("done"), F.col("total"), elapsed), 1).alias("left"))


def page(detail: DataFrame, template: str, **more) -> str:
    """One self-contained page from the detail sections (section, json), bounded by their top-k cuts."""
    import json

    values = {r["section"].upper(): json.loads(r["json"]) for r in detail.collect()}
    return render_page(template, values | more)


def graph_product(people: DataFrame, settings: DataFrame, relations: DataFrame, *, top: int = 600) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of characters and settings: co-occurrence, relations, the heaviest nodes.

    people: (scene, chapter, name); relations: (name, to, how, ord) between settings.
    """
    named = people.select("name").distinct()
    pairs = graphs.cooccurrence(people, "scene", "name").select("a", "b", F.lit("cooccur").alias("kind"), F.col("weight").cast("string").alias("label"))
    linked = graphs.setting_edges(relations, settings.select("name"), named).select("a", "b", F.lit("related").alias("kind"), F.col("how").alias("label"))
    edges = pairs.unionByName(linked)
    nodes = graphs.nodes(people.select("name", "chapter")).withColumn("kind", F.lit("character"))
    places = settings.join(named, "name", "left_anti").select("name", F.array().cast(nodes.schema["chapters"].dataType).alias("chapters"), F.lit(None).cast(nodes.schema["first_seen"].dataType).alias("first_seen"), F.lit("setting").alias("kind"))
    return graphs.truncated(graphs.weighted_nodes(nodes.unionByName(places), edges), edges, top, F.col("kind") == "setting")
