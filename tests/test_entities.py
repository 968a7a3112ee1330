import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import characters, entities, folds, graphs, lexicon, retrieval, router
from loomtext.operators.components import components

CHARS = "name string, aliases array<string>, first_seen long, description string, ord long"


def chars(spark, rows):
    return spark.createDataFrame([(n, a, fs, d, i) for i, (n, a, fs, d) in enumerate(rows)], CHARS)


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5)] + [(400 + i, 401 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_aliases_join_names(spark):
    rows = [
        ("Orrin", ["the Fox", "Captain Vell"], 1, "short"),
        ("the Fox", ["Orrin"], 3, "a longer text"),
        ("Captain Vell", [], 2, ""),
        ("Guard One", ["Guard Two"], 5, ""),
        ("Guard Two", ["Guard One"], 6, ""),
        ("Selfish", ["Selfish"], 7, None),
    ]
    bad = spark.createDataFrame([("Guard Two", "Guard One")], "a string, b string")
    got = {r.canonical: r for r in entities.merge_entities(chars(spark, rows), blacklist=bad).collect()}
    assert {frozenset(r.members) for r in got.values()} == {frozenset(["Orrin", "the Fox", "Captain Vell"]), frozenset(["Guard One"]), frozenset(["Guard Two"]), frozenset(["Selfish"])}
    fox = next(r for r in got.values() if len(r.members) == 3)
    assert fox.canonical == "Captain Vell"  # listed once like the others, and the longest
    assert fox.aliases == ["the Fox", "Orrin"] and fox.first_seen == 1 and fox.description == "a longer text"
    assert len({n for r in got.values() for n in r.members}) == len(rows)


def test_merge_is_idempotent(spark):
    rows = [("a", ["b"], 1, ""), ("b", ["c"], 2, ""), ("c", [], 3, ""), ("d", [], 4, "")]
    once = entities.merge_entities(chars(spark, rows))
    again = entities.merge_entities(once.select(F.col("canonical").alias("name"), "aliases", "first_seen", "description", F.xxhash64("canonical").alias("ord")))
    assert sorted((r.canonical, r.aliases) for r in again.collect()) == sorted((r.canonical, r.aliases) for r in once.collect())


def test_mutual_edges(spark):
    table = spark.createDataFrame([("x", ["y"]), ("y", ["x"]), ("z", ["x"]), ("p", ["q"]), ("q", ["p"])], "name string, aliases array<string>")
    assert [tuple(r) for r in entities.mutual_edges(table, blacklist=spark.createDataFrame([("q", "p")], "a string, b string")).collect()] == [("x", "y")]
    known = spark.createDataFrame([("p",), ("q",), ("x",)], "name string")
    assert [tuple(r) for r in entities.mutual_edges(table, known).collect()] == [("p", "q")]


def test_enrich_leaves_noise_out(spark):
    base = entities.merge_entities(chars(spark, [("Ann", ["Annie"], 1, ""), ("Bob", [], 2, "")]))
    more = spark.createDataFrame([("Ann", ["Nan", "Bob", "a, b", "far too long for an alias"])], "name string, aliases array<string>")
    got = {r.canonical: r.aliases for r in entities.enrich(base, more).collect()}
    assert got == {"Ann": ["Annie", "Nan"], "Bob": []}
    names = {r.name: r.canonical for r in entities.canonical_map(base).collect()}
    assert names == {"Ann": "Ann", "Annie": "Ann", "Bob": "Bob"}


def test_registry_tables(spark):
    rows = [(2, "A", ["a", "A"], "place"), (1, "A", ["b"], ""), (1, "B", [], "人物"), (3, " ", ["x"], "")]
    reg = spark.createDataFrame(rows, "chapter_no int, canonical string, aliases array<string>, category string")
    got = {r.canonical: (r.aliases, r.category) for r in entities.registry_flat(reg).collect()}
    assert got == {"A": (["a", "b"], "place"), "B": ([], "人物")}
    assert [r.name for r in entities.alias_union(reg).collect()] == ["B"]


def test_containment_and_personality(spark):
    rows = spark.createDataFrame([(1, "old Marn"), (2, "x"), (3, "")], "k int, t string")
    names = spark.createDataFrame([("Marn", 5), ("old", 2)], "name string, ord int")
    assert [tuple(r) for r in entities.first_containing(rows, names, "k", "t").collect()] == [(1, "old Marn", "old")]
    scores = spark.createDataFrame([("a", "kind", 40.0), ("b", "kind", 70.0), ("b", "kind", 100.0)], "name string, dim string, score double")
    names = spark.createDataFrame([("a", "a"), ("b", "a")], "name string, canonical string")
    assert entities.merge_personality(scores, names).first().score == 70.0  # a true mean


def test_graph_tables(spark):
    members = spark.createDataFrame([(s, n) for s, ns in enumerate(["ab", "ab", "abc", "c"]) for n in ns], "scene int, name string")
    pairs = graphs.cooccurrence(members, "scene", "name")
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 3)]
    without = spark.createDataFrame([("b", "a")], "a string, b string")
    assert graphs.cooccurrence(members, "scene", "name", without=without).count() == 0
    with pytest.raises(ValueError):
        graphs.cooccurrence(members, "scene", "name", max_group=2)
    acts = spark.createDataFrame([(0, "a"), (0, "a"), (2, "c")], "scene int, who string")
    got = {(r.actor, r.other): r.acts for r in graphs.directed_cooccurrence(acts, members, "scene", "who", "name").collect()}
    assert got == {("a", "b"): 2, ("c", "a"): 1, ("c", "b"): 1}
    rel = spark.createDataFrame([("s", "t", "x", 1), ("t", "s", "y", 2), ("s", "p", "z", 3), ("s", "nobody", "w", 4)], "name string, `to` string, how string, ord int")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    edges = graphs.setting_edges(rel, names("s", "t"), names("p")).collect()
    assert sorted((r.a, r.b, r.how, r.kind) for r in edges) == [("s", "p", "z", "character"), ("s", "t", "x", "setting")]


def test_text_fold(spark):
    rows = [(1, i, t) for i, t in enumerate(["ab", "b", "cd", "ab", None, "", "abcd"])]
    df = spark.createDataFrame(rows, "k int, o int, t string").repartition(4)
    assert folds.text_fold(df, ["k"], ["o"], "t", ";").first().t == "ab;cd;abcd"


def test_entity_fold_learns_aliases(spark):
    cols = "book int, scene int, name string, category string, aliases array<string>, description string, motivation string, persona string, psychology string"
    rows = [(1, 1, "Mar", "", ["the Owl"], "tall", "", "", ""), (1, 2, "the Owl", "", [], "old", "", "", ""), (1, 3, "the Owl", "place", [], "a hill", "", "", ""), (1, 3, " ", "", [], "x", "", "", ""), (2, 1, "the Owl", "", [], "other", "", "", "")]
    got = sorted((r.book, r.name, r.category, r.description, r.scenes) for r in folds.entity_fold(spark.createDataFrame(rows, cols), ["book"]).collect())
    assert got == [(1, "Mar", "人物", "tall；old", [1, 2]), (1, "the Owl", "place", "a hill", [3]), (2, "the Owl", "人物", "other", [1])]


def test_facts_and_profiles(spark):
    acts = [(1, 1, i, "A", "say" if i % 2 else "do", f"c{i}") for i in range(30)] + [(2, 2, 0, "B", "see", "x" * 100)]
    acts = spark.createDataFrame(acts, "chapter int, scene int, pos int, who string, channel string, content string")
    people = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B"), (2, "C")], "scene int, name string")
    got = {r.name: r for r in characters.facts(acts, people).collect()}
    assert got["A"].sayings == [f"c{i}" for i in range(7, 30, 2)] and got["A"].doings[-1] == "c28" and len(got["A"].doings) == 12
    assert got["A"].co_occurrences == {"B": 30} and got["B"].co_occurrences == {"C": 1}
    assert [tuple(a) for a in got["B"].appearances] == [(2, 2)] and len(got["B"].doings[0]) == 80
    assert got["C"].appearances == [] and got["C"].sayings == []
    facts = characters.facts(acts, people)
    resumes = spark.createDataFrame([("A", "lead", ["e"], [], "up")], "name string, identity string, events array<string>, relations array<string>, arc string")
    aliases = spark.createDataFrame([("A", ["a"])], "name string, aliases array<string>")
    out = {r.name: r for r in characters.profiles(facts, resumes, aliases).collect()}
    assert out["A"].events == ["e"] and out["A"].relations == ["与B: 30"] and out["B"].events == ["x" * 80] and out["B"].first_chapter == 2


def test_lexicon(spark):
    slots = spark.createDataFrame(
        [("craft", "grade", ["low", "mid", "high", "top", "peak"], True, 0), ("craft", "rite", ["one", "two"], True, 1), ("sea", "ship", ["sloop", "low"], False, 2)],
        "domain string, slot string, items array<string>, ordered boolean, ord int",
    )
    nodes = lexicon.lexicon_nodes(slots)
    assert {r.id: r.domain for r in nodes.collect()}["low"] == "craft"  # the first domain has it
    edges = lexicon.lexicon_edges(nodes)
    assert {(r.a, r.b) for r in edges.where("type = 'next_level'").collect()} == {("low", "mid"), ("mid", "high"), ("high", "top"), ("top", "peak"), ("one", "two")}
    assert {(r.a, r.b) for r in edges.where("type = 'aligned_with'").collect()} == {("low", "one"), ("mid", "two")}
    start = spark.createDataFrame([("low",)], "id string")
    two = {(r.id, r.hop) for r in lexicon.neighbours(edges, start, 2).collect()}
    assert ("high", 2) in two and ("two", 2) in two and not any(i == "top" for i, _ in two)  # not through the centre
    used = spark.createDataFrame([("low",), ("top",)], "id string")
    assert [r.id for r in lexicon.gaps(nodes, used).orderBy("rank").collect()] == ["mid", "high"]
    assert lexicon.gaps(nodes, used.limit(1)).count() == 0
    genres = spark.createDataFrame([("craft",), ("seafaring",), ("odd",)], "genre string")
    names = spark.createDataFrame([("sea", "sea", 0)], "alias string, domain string, ord int")
    got = {r.genre: r.domain for r in lexicon.resolve_genre(genres, names, slots.select("domain")).collect()}
    assert got == {"craft": "craft", "seafaring": "sea", "odd": "odd"}
    terms = spark.createDataFrame([("",), ("sword",), ("big sword",), ("number 5",), ("jade sword",)], "name string")
    words = spark.createDataFrame([("sword",), ("jade sword",)], "word string")
    assert {r.name for r in lexicon.without_generic(terms, words, "name", ["number"], ["jade"]).collect()} == {"big sword", "jade sword"}


def test_layered_search(spark):
    nodes = spark.createDataFrame([(w, i) for i, w in enumerate(["stone", "stone gate", "old stone", "stowe", "tree"])], "id string, ord int")
    got = [(r.id, r.score) for r in retrieval.layered_search(spark.createDataFrame([("stone",)], "query string"), nodes).orderBy("rank").collect()]
    assert got == [("stone", 1.0), ("stone gate", 0.8), ("old stone", 0.6), ("stowe", 0.45)]
    few = retrieval.layered_search(spark.createDataFrame([("stone",)], "query string"), nodes, top=2)
    assert [r.id for r in few.orderBy("rank").collect()] == ["stone", "stone gate"]


def test_full_text_and_vectors(spark):
    docs = spark.createDataFrame([(1, "红月高悬，夜色很深"), (2, "the red moon stands high"), (3, "nothing here")], "id long, text string")
    postings, lengths = retrieval.build_index(docs, "id", "text")
    assert [r.id for r in retrieval.full_text(docs, postings, lengths, "id", "text", "红月").collect()] == [1]
    assert [r.id for r in retrieval.full_text(docs, postings, lengths, "id", "text", "Moon?").collect()] == [2]
    assert [(r.id, r.score) for r in retrieval.full_text(docs, postings, lengths, "id", "text", "othing h").collect()] == [(3, 0.0)]
    cache = spark.createDataFrame([], "key string, model string, vec array<float>")
    rows, new = retrieval.embed_cached(docs.union(docs), cache, "m")
    assert new.count() == 3 and rows.where("vec IS NULL").count() == 0
    assert retrieval.embed_cached(docs, new, "m")[1].count() == 0
    vec = rows.where("id = 2").first()["vec"]
    assert retrieval.nearest(rows.dropDuplicates(["id"]), "id", "vec", vec, 1).first()["id"] == 2


def test_router_batch_and_layers(spark):
    rows = [(1, i, i == 4, True, False, False, 0) for i in range(10)] + [(2, i, i < 3, False, False, False, 0) for i in range(4)] + [(3, 0, False, False, False, False, 2)] + [(4, 0, False, False, False, True, 0)]
    df = spark.createDataFrame(rows, "k int, o int, is_hit boolean, is_unknown boolean, is_definition boolean, is_meme boolean, gap_size int")
    assert sorted(tuple(r) for r in router.decisions(df.repartition(5), ["k"], ["o"]).collect()) == [(1, 7, "R2"), (2, 2, "R1"), (3, 0, "R3")]
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    local = spark.createDataFrame([("a", "def")], "name string, definition string")
    hits = spark.createDataFrame([("b", "bb", 0.8, 1), ("a", "aa", 0.8, 1)], "query string, id string, score double, rank int")
    assert {r.query: (r.layer, r.answer) for r in router.search_external(queries, local, hits).collect()} == {"a": (1, "def"), "b": (2, "bb"), "c": (0, "")}
