import pytest
from pyspark.sql import functions as F

from loomtext.plans import products
from loomtext.plans.models import Offline
from loomtext.sources import sinks, tables

ACTS = "array<struct<type:string,channel:string,who:string,content:string,scope:array<string>>>"


@pytest.fixture(scope="module")
def records(spark):
    rows = [(f"s{c}{k}", c, "hall", [("act", "say", "Orrin", f"word {c}{k}", ["*"]), ("event", None, None, "rain", ["*"])], "", "ok", f"Orrin met Vella in the hall {c}{k}") for c in range(1, 5) for k in range(2)]
    return spark.createDataFrame(rows, f"scene_id string, chapter_no int, `where` string, actinfo {ACTS}, notes string, extract_status string, raw_text string")


def test_outlines_and_blocks(spark, records, tmp_path):
    cache = str(tmp_path / "cache")
    text = products.act_stream(records).where("chapter_no = 1").first()["text"]
    assert text.split("\n") == ["hall", "Orrin [say] word 10", "* rain", "hall", "Orrin [say] word 11", "* rain"]
    out = products.outlines(spark, records, Offline(), cache)
    assert out.count() == 4 and out.where("summary = ''").count() == 0
    assert products.book_summary(spark, out, Offline(), cache).count() == 1
    blocks = products.character_blocks(records, max_chapters=3, max_chars=100_000)
    assert [r.chunk for r in blocks.orderBy("chapter_no").collect()] == [0, 0, 0, 1]
    people = records.select(F.col("scene_id").alias("scene"), F.explode(F.array(F.lit("Orrin"), F.lit("Vella"))).alias("name"))
    assert [(r.name, r.n) for r in products.frequent_names(people).collect()] == [("Orrin", 8), ("Vella", 8)]


def test_model_products(spark, records, tmp_path):
    cache = str(tmp_path / "cache")
    facts = spark.createDataFrame([("Orrin", [(1, 1), (1, 2)], ["hello"], ["went"]), ("Once", [(1, 1)], [], [])], "name string, appearances array<struct<chapter:int,scene:int>>, sayings array<string>, doings array<string>")
    clues = spark.createDataFrame([], "name string")
    assert [r.name for r in products.resumes(spark, facts, clues, Offline(), cache).collect()] == ["Orrin"]
    assert products.reviews(spark, {"plot": "a", "style": "b"}, Offline(), cache).count() == 2
    numbered = records.withColumn("scene_no", F.xxhash64("scene_id"))
    hits = numbered.limit(2).select("scene_no", F.lit(1.0).alias("score"))
    got = products.answer(spark, hits, numbered, "who?", Offline(), cache, key="scene_no").first()
    assert got["question"] == "who?" and got["context"].count("Orrin met Vella") == 2 and got["answer"]
    terms = spark.createDataFrame([("Hall", ["the room"], "a big room", ["s10"])], "name string, aliases array<string>, definition string, source_scenes array<string>")
    assert products.define(spark, "the room", terms, records, ["raw_text"], Offline(), cache).first()["source"] == "graph"
    assert products.define(spark, "Vella", terms, records, ["raw_text"], Offline(), cache).first()["source"] == "context"
    assert products.strengthen(spark, terms, Offline(), cache).count() == 1


def test_reports(spark, tmp_path):
    reg = spark.createDataFrame([(1, "Ann", ["A."], "x"), (1, "Bob", [], "x")], "chapter_no int, canonical string, aliases array<string>, category string")
    wanted = spark.createDataFrame([("Ann",), ("Zed",)], "name string")
    report = products.comparison(spark, {"one": reg, "two": reg.limit(1)}, wanted)
    assert "## one and two" in report and "| 2 | 2 | 1 | 2.0 | 1 | 2 |" in report
    assert products.prompt_block(reg, 1).first()["block"] == "Ann (A.)\nBob"
    log = sinks.RunLog(str(tmp_path / "log"))
    log.progress("extract", 1, 4)
    log.progress("extract", 2, 4)
    log.gauge("extract", "empty_rate", 0.5)
    log.gauge("extract", "terms", 400)
    rows = tables.log_records(spark, log.path)
    assert {r.check: r.ok for r in products.log_report(rows).collect()} == {"errors": True, "empty_rate": False, "terms": True}
    assert [(r.step, r.bar) for r in products.panel(rows).collect()] == [("extract", "########--------")]
    detail = spark.createDataFrame([("chapters", '[{"t": "</b>"}]')], "section string, json string")
    assert products.page(detail, "<script>{{CHAPTERS}}{{BOOK}}</script>", BOOK="x") == '<script>[{"t": "<\\/b>"}]"x"</script>'


def test_graph_product(spark):
    people = spark.createDataFrame([(s, 1, n) for s in range(3) for n in "ab"], "scene int, chapter int, name string")
    settings = spark.createDataFrame([("hall",), ("a",)], "name string")
    rel = spark.createDataFrame([("hall", "a", "home of", 0)], "name string, `to` string, how string, ord int")
    nodes, edges = products.graph_product(people, settings, rel, top=1)
    assert {r.name: (r.kind, r.weight) for r in nodes.collect()} == {"a": ("character", 3), "hall": ("setting", 1)}
    assert [(r.a, r.b, r.kind) for r in edges.collect()] == [("hall", "a", "related")]
