import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import segment as S

LEAST, MOST = S.LEAST, S.MOST


def flat(blocks):
    return [x for b in blocks for x in b]


@pytest.mark.parametrize("n", [1, 7, 8, 15, 16, 17, 31, 100])
def test_mechanical_split(n):
    pieces = [p for p, _ in S.split_oversize(list(range(n)), True, None)]
    assert flat(pieces) == list(range(n))
    assert all(len(p) == MOST for p in pieces[:-1]) and 0 < len(pieces[-1]) <= MOST


def test_split_at_the_weakest_link():
    sims = {i: 0.9 for i in range(40)} | {11: 0.1, 13: 0.1}
    pieces = S.split_oversize(list(range(24)), True, sims.get)
    assert [p[0] for p, _ in pieces] == [0, 11] and [prot for _, prot in pieces] == [True, False]
    # 16 rows have no place with enough on either side: cut in the middle
    assert [len(p) for p, _ in S.split_oversize(list(range(16)), False, sims.get)] == [8, 8]
    # no link known: at the limit, or in the middle if that is nearer
    assert [len(p) for p, _ in S.split_oversize(list(range(20)), False, lambda i: None)] == [10, 10]


def test_free_merge_covers_everything_in_order():
    rng = random.Random(6)
    for _ in range(200):
        rows = iter(range(10_000))
        blocks = [[next(rows) for _ in range(rng.randint(1, 20))] for _ in range(rng.randint(1, 12))]
        opens = {b[0] for b in blocks if rng.random() < 0.3}
        for done in (S.merge_freely(blocks, lambda b: b[0] in opens), S.merge_additive([(b, b[0] in opens) for b in blocks])):
            assert flat(done) == flat(blocks) and all(done)
        assert max(map(len, S.merge_freely(blocks, lambda b: b[0] in opens))) <= MOST


def test_fragment_rules():
    never, always = (lambda b: False), (lambda b: True)
    make = lambda *sizes: [[(k, i) for i in range(n)] for k, n in enumerate(sizes)]
    sizes = lambda blocks: [len(b) for b in blocks]
    assert sizes(S.merge_freely(make(10, 3, 10), never)) == [13, 10]  # backward where it fits
    assert sizes(S.merge_freely(make(14, 3, 10), never)) == [14, 13]  # else forward
    assert sizes(S.merge_freely(make(14, 3), never)) == [15, 2]  # else backward anyhow, then cut
    assert sizes(S.merge_freely(make(3), never)) == [3]
    assert sizes(S.merge_freely(make(9, 3, 10), lambda b: len(b) == 3)) == [9, 13]  # a switch start only forward
    assert sizes(S.merge_freely(make(9, 3, 14), lambda b: len(b) == 3)) == [9, 3, 14]
    assert sizes(S.merge_additive([(b, False) for b in make(14, 3, 14)])) == [14, 3, 14]  # nowhere does it fit
    assert sizes(S.merge_additive([(b, p) for b, p in zip(make(9, 3, 9), (False, True, False))])) == [9, 12]
    assert always([1])


def test_bounds():
    assert S.normalise_bounds(40, [9, 14, 23, 30]) == [14, 23, 38, 40]
    for n in (1, 7, 8, 15, 16, 31, 64):
        ends = S.normalise_bounds(n, [5, 10, 20, 33, 50])
        assert ends[-1] == n and all(0 < b - a <= MOST for a, b in zip([0, *ends], ends))


def test_beats():
    paras = ["the first line here", "second one stands", "third and more", "fourth", "the last of them"]
    got = S.resolve_beats(paras, ["third and so on", "nowhere to be found", "the firs", "third an"], first=10)
    assert [g[1] for g in got] == sorted({g[1] for g in got})
    assert got[0][1] == 10 and got[-1][2] == 14
    assert all(a[2] + 1 == b[1] for a, b in zip(got, got[1:]))
    assert S.resolve_beats([], []) == []


def test_pack_scenes_covers_all_rows(spark):
    rng = random.Random(1)
    rows = [(b, c, p, ("“a”" if rng.random() < 0.5 else "plain") + str(p)) for b in ("x", "y") for c in (1, 2) for p in range(1, rng.randint(20, 60))]
    df = spark.createDataFrame(rows, "book string, chapter int, para long, text string").repartition(7)
    broken = S.rule_breaks(df, ["book", "chapter"], "para", F.col("text").startswith("“"), ["plain3"]).withColumn("switch", F.col("text").startswith("plain3"))
    got = S.pack_scenes(broken, ["book", "chapter"], "para", switch="switch").collect()
    seen = sorted((r.book, r.chapter, p) for r in got for p in range(r.start, r.end + 1))
    assert seen == sorted((b, c, p) for b, c, p, _ in rows)
    assert all(r.size == r.end - r.start + 1 <= MOST for r in got)
    again = S.pack_scenes(broken.repartition(1), ["book", "chapter"], "para", switch="switch").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_dialogue_run_breaks(spark):
    rows = [(1, i, t) for i, t in enumerate(["“a”", "“b”", "“c”", "plain", "“d”", "“e”", "plain"])]
    df = spark.createDataFrame(rows, "k int, p int, text string")
    got = S.dialogue_breaks(df, ["k"], "p", F.col("text").startswith("“")).orderBy("p").collect()
    assert [r.brk for r in got] == [False, False, False, True, False, False, False]


def test_vectors_and_chunks(spark):
    vec = lambda x: [1.0, x]
    rows = [(1, i, vec(0.0 if i < 12 else 5.0), 0) for i in range(24)]
    df = spark.createDataFrame(rows, "k int, p long, v array<double>, block int")
    got = S.pack_scenes(df, ["k"], "p", vec="v").orderBy("event_seq").collect()
    assert [(r.start, r.end) for r in got] == [(0, 11), (12, 23)]
    brk = S.cosine_breaks(df, ["k"], "p", "v").where("brk").collect()
    assert [r.p for r in brk] == [12]
    chunks = S.chunk_by_budget(spark.createDataFrame([(1, i, s) for i, s in enumerate([10, 10, 50, 5, 5, 5, 5])], "k int, p int, n long"), ["k"], "p", "n", max_rows=3, max_size=40)
    assert [r.chunk for r in chunks.orderBy("p").collect()] == [0, 0, 0, 1, 1, 1, 2]
