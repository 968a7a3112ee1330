import pytest
from pyspark.sql import functions as F

from loomtext.operators import audit, characters, entities, folds, graphs, lexicon, router, runlog, style
from loomtext.sources import tables


def table(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_speech_share_and_foils(spark):
    acts = table(spark, "k int, channel string, content string", (1, "say", "A: four"), (1, "do", "12345678"), (1, "see", "1234"), (2, "see", ""))
    got = {r.k: (r.say_share, r.do_share) for r in style.speech_share(acts, ["k"]).collect()}
    assert got == {1: (0.25, 0.5), 2: (0.0, 0.0)}
    scenes = table(spark, "raw_text string, who array<string>", ("rain fell", ["A"]), ("rain", []), ("dry", ["A"]))
    assert style.foils(scenes, "rain|snow").count() == 1


@pytest.mark.parametrize(("n", "want"), [(0, []), (2, [0, 1]), (6, [0, 1, 2]), (7, [0, 2, 4, 6]), (12, [0, 4, 8, 11])])
def test_arc_points(spark, n, want):
    arc = spark.range(n).withColumn("score", F.lit(0.5))
    assert [r.id for r in style.arc_points(arc, "id").orderBy("id").collect()] == want


def test_place_cuts_skip_unknown_places(spark):
    rows = table(spark, "c int, s int, `where` string", (1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "a"), (1, 5, "a"), (2, 1, None))
    assert {r.c: r.cuts for r in style.place_cuts(rows, ["c"], ["s"]).collect()} == {1: 1, 2: 0}


def test_style_words_and_top_words(spark):
    freq = table(spark, "word string, pos string, n int", ("hall", "n", 3), ("think", "v", 4), ("red", "a", 2))
    out = style.style_words(freq, table(spark, "word string", ("hall",)), table(spark, "word string", ("think",)))
    assert {r.word: r["group"] for r in out.collect()} == {"hall": "content", "red": "style"}
    docs = table(spark, "k int, text string", (1, "b a b a cc dd dd ee"), (1, None))
    stop = table(spark, "word string", ("dd",))
    assert [(r.word, r["rank"]) for r in style.top_words(docs, ["k"], 1, stop=stop).collect()] == [("cc", 1)]


def test_ties_do_not_depend_on_partitions(spark):
    docs = table(spark, "k int, text string", *[(i % 2, "xx yy zz ww vv") for i in range(40)])
    seen = {tuple(sorted((r.k, r.word, r["rank"]) for r in style.top_words(docs.repartition(p), ["k"], 3).collect())) for p in (1, 4, 16)}
    assert len(seen) == 1


def test_baseline_means_over_books(spark):
    ledger = table(spark, "genre string, metric string, value double", ("a", "m", 1.0), ("a", "m", 2.0), ("b", "m", 6.0), ("b", "r", None))
    got = {(r.metric, r.genre): (r["mean"], r.n_books) for r in style.baseline(ledger, "genre").collect()}
    assert got == {("m", "a"): (1.5, 2), ("m", "b"): (6.0, 1), ("m", "all"): (3.0, 3), ("r", "b"): (None, 1), ("r", "all"): (None, 1)}


def test_small_graph_helpers(spark):
    rows = table(spark, "name string, links array<string>", ("a", ["x", "y"]), ("b", ["x"]), ("c", []))
    assert [(r.name, r.n) for r in graphs.hubs(rows, "name", "links", 2).collect()] == [("a", 2), ("b", 1)]
    mapping = table(spark, "`from` string, `to` string", ("x", "X"))
    assert {r.t for r in graphs.mapped(table(spark, "t string", ("x",), ("q",)), "t", mapping).collect()} == {"X", "其他"}
    buckets = graphs.category_buckets(table(spark, "c string, name string", ("p", "b"), ("p", "a"), ("p", "d")), "c", "name", 2).first()
    assert buckets["names"] == ["a", "b"] and buckets["n"] == 3
    wide = table(spark, "k string, ch int", ("a", 1), ("a", 6), ("b", 1), ("b", 5))
    assert [r.k for r in graphs.wide_clusters(wide, "k", "ch").collect()] == ["a"]
    rel = table(spark, "name string, target string, label string", ("A", "Bee", "friend"), ("A", "old Cee", "foe"), ("A", "A", "self"))
    names = table(spark, "name string, canonical string", ("A", "A"), ("Bee", "B"), ("Cee", "C"))
    assert sorted((r.a, r.b, r.label) for r in graphs.explicit_edges(rel, names).collect()) == [("A", "B", "friend"), ("A", "C", "foe")]
    times = table(spark, "c int, o int, t string", (1, 2, "b"), (1, 1, "a"))
    assert graphs.timeline(times, "c", "t", "o").first()["events"] == ["a", "b"]


def test_merge_settings(spark):
    rows = table(
        spark, "name string, type string, description string, related array<string>, ord int",
        ("Keep", "fort", "big", ["x"], 1), ("the Keep", "", "much bigger", ["y", "x"], 2), ("Ann", "person", "", [], 3), ("Hill", "", None, [], 4),
    )
    aliases = table(spark, "name string, canonical string", ("the Keep", "Keep"))
    got = {r.name: (r.related, r.description, r.type) for r in graphs.merge_settings(rows, aliases, table(spark, "name string", ("Ann",))).collect()}
    assert got == {"Keep": (["x", "y"], "much bigger", "fort"), "Hill": ([], None, None)}
    assert graphs.well_related(rows, 2).count() == 1


def test_settings_folds(spark):
    deltas = table(
        spark, "scene int, ord int, name string, category string, definition string, aliases array<string>",
        (2, 0, "the Gate", "place", "old", []), (1, 0, "Gate", "", "a gate", ["Door"]), (3, 0, "Gate", "thing", "old", None),
    )
    canonical = table(spark, "name string, canonical string", ("the Gate", "Gate"))
    r = folds.settings_fold(deltas.repartition(3), canonical).first()
    assert (r["name"], r.category, r.definition, r.aliases, r.source_scenes, r.first_seen, r.last_seen) == ("Gate", "place", "a gate；old", ["Door", "the Gate"], [1, 2, 3], 1, 3)
    rel = table(spark, "`from` string, `to` string, type string, ord int", ("a", "b", "x", 2), ("a", "b", "y", 1), ("b", "a", "z", 3), ("a", "a", "s", 0))
    assert sorted((r["from"], r["to"], r.type) for r in folds.directed_relations(rel).collect()) == [("a", "b", "y"), ("b", "a", "z")]
    terms = table(spark, "name string, category string, definition string, source_scenes array<int>, ord int", ("a", "p", "one", [2], 1), ("b", "p", "two", [1], 2), ("c", "q", "three", [3], 3))
    merged = folds.synonym_merge(terms, table(spark, "a string, b string", ("a", "b"), ("a", "c")))
    assert sorted((r["name"], r.definition, r.aliases, r.source_scenes) for r in merged.collect()) == [("a", "one；two", ["b"], [1, 2]), ("c", "three", [], [3])]
    lists = table(spark, "k int, o int, x array<string>", (1, 2, ["c", "a"]), (1, 1, ["a", "b"]))
    assert folds.union_in_order(lists, ["k"], ["o"], "x").first()["x"] == ["a", "b", "c"]
    texts = table(spark, "k int, o int, t string", (1, 1, "aa"), (1, 2, "bb"), (1, 3, "c"))
    assert folds.longest(texts, ["k"], "t", "o").first()["t"] == "aa"


def test_router_helpers(spark):
    rows = table(spark, "n string", ("yyds",), ("NTR",), ("ab12",), ("烂梗",), ("打脸",), ("新套路",), ("套路书",), ("Plain Name",), ("longerthan8",), ("红月",))
    assert {r.n for r in rows.where(router.looks_like_meme(F.col("n"))).collect()} == {"yyds", "NTR", "烂梗", "打脸", "新套路"}
    nodes = table(spark, "id string, domain string", ("a", "x"), ("b", "y"))
    count = lambda on, domains: nodes.where(lexicon.scoped(on, domains, F.col("domain"))).count()
    assert [count(False, None), count(True, None), count(True, ["x"])] == [0, 2, 1]
    assert lexicon.edge_counts(table(spark, "type string", ("a",), ("a",))).first()["n"] == 2


def test_evidence_and_tops(spark):
    clues = table(spark, "names array<string>, text string, ord int", (["A", "B"], "second", 2), (["A"], "first", 1))
    assert {r.name: r.texts for r in characters.evidence_index(clues).collect()} == {"A": ["first", "second"], "B": ["second"]}
    facts = table(spark, "name string, appearances array<int>", ("a", [1, 2, 3]), ("b", [1]), ("c", [1, 2]))
    assert {r.name for r in characters.top_characters(facts, 1).collect()} == {"a"}
    assert {r.name for r in characters.top_characters(facts, 1, table(spark, "name string", ("c",), ("b",)), 2).collect()} == {"a", "c"}
    terms = table(spark, "name string, source_scenes array<int>", ("x", [1]), ("y", [1, 2]))
    assert [r.name for r in characters.top_settings(terms, 1).collect()] == ["y"]


def test_audits(spark):
    edges = table(spark, "a string, b string", ("x", "y"))
    sets = table(spark, "name string, chapters array<int>", ("x", [3, 1]), ("z", [9]))
    assert audit.chapter_sets(edges, sets).first()["chapters"] == [1, 3]
    scenes = table(spark, "scene_id int", (1,), (2,))
    records = table(spark, "scene_id int, notes string", (1, "n"))
    joined = audit.with_records(scenes, records)
    assert {r.scene_id: r.extract_status for r in joined.collect()} == {1: "ok", 2: "pending"}
    assert {r.name: (r.n, r.ok) for r in audit.table_counts(scenes=joined, records=records).collect()} == {"scenes": (2, 1), "records": (1, None)}
    assert [r.scene_id for r in audit.todo(scenes, records, "scene_id").collect()] == [2]
    with pytest.raises(ValueError):
        audit.assert_covered(scenes, ["scene_id"], records)
    audit.assert_covered(scenes, ["scene_id"], records, table(spark, "scene_id int", (2,)))


def test_tables(spark, tmp_path):
    runs = table(spark, "book string, path string, mtime int", ("a", "p1", 1), ("b", "p2", 9), ("a", "p3", 5))
    assert tables.newest_run(runs).first()["path"] == "p2" and tables.newest_run(runs, "a").first()["path"] == "p3"
    assert tables.union_roots(runs, runs).count() == 3
    (tmp_path / "x.log").write_text("start\n耗时 75.0s\n耗时 9 s\n")
    assert tables.seconds_of(spark.read.text(str(tmp_path / "x.log"))).first()["seconds"] == 75.0
    scenes = table(spark, "scene_id int, chapter_no int, extract_status string, raw_text string", (2, 1, "ok", "x" * 500), (1, 1, "pending", ""), (3, 9, "ok", ""))
    assert [(r.scene_id, len(r.raw_text)) for r in tables.scene_meta(scenes, 5).collect()] == [(2, 400)]
    first = entities.first_match(table(spark, "n string", ("x",), ("q",)), table(spark, "term string, aliases array<string>, ord int", ("B", ["x"], 2), ("A", ["x"], 1)), "n")
    assert {r.n: r.term for r in first.collect()} == {"x": "A", "q": None}
    usage = table(spark, "model string, prompt int, completion int", ("m", 1, 2), ("m", 3, 4), ("n", 5, 6))
    assert {r.model: (r.prompt, r.calls) for r in runlog.token_ledger(usage).collect()} == {"m": (4, 2), "n": (5, 1), "all": (9, 3)}
