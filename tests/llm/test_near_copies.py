import random

from loomtext.llm import near_copies, simhash, stages

from .helpers import AWKWARD, table
from .test_simhash import closure


def sets(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows):
    """The places of the rows that stay."""
    have = [sets(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(have[i] & have[j]) >= 4 * (len(have[i]) + len(have[j]))]
    groups = {}
    for i, root in closure(near, range(len(rows))).items():
        groups.setdefault(root, []).append(i)
    return {min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()}


def corpus(seed, copies):
    """Texts with copies from far over to far under a similarity of 0.8, and a passage in many."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(words) for _ in range(12)]
    rows = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([4, 9, 30, 120, 400]))]
        rows.append(base)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(text + passage if rng.random() < 0.2 else text)
    rng.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_stage_equals_brute_force_at_a_similarity_of_08(spark):
    rows = corpus(3, 6)
    want = {rows[i][0] for i in brute(rows)}
    assert 30 <= len(want) < len(rows)
    docs = table(spark, rows).repartition(3)
    assert {r.doc_id for r in stages.simhash_near_dedup(spark, docs, "").collect()} == want


def test_large_keys_lose_no_link(spark):
    rows = corpus(5, 7)
    want = {rows[i][0] for i in brute(rows)}
    for rounds in (0, 1, 3):
        got = near_copies.dedup(table(spark, rows).repartition(3), bucket=2, rounds=rounds)
        assert {r.doc_id for r in got.collect()} == want


def test_awkward_rows_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [r for r in AWKWARD if r[0] is not None] + [(70, base), (70, "nothing like it, in no way at all"), (60, base + " end"), (None, base + " more"), (None, "a null id of its own")]
    got = near_copies.dedup(table(spark, rows))
    assert got.columns == table(spark, []).columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted((rows[i][0] or -1, rows[i][1] or "") for i in brute(rows))
    assert near_copies.dedup(table(spark, [])).count() == 0


def test_fingerprints_find_candidates_of_the_stage(spark, monkeypatch):
    rng = random.Random(11)
    long = [" ".join(f"w{rng.randrange(500)}" for _ in range(600)) for _ in range(8)]
    texts = [t for base in long for t in (base, base + " end", base.upper(), "x " + base)] + ["w1 w2 w3 w4 w5 w6"] * 3
    rows = [(i, simhash.fingerprint(t.encode(), 5)) for i, t in enumerate(texts)]
    want = closure([(i, j) for i, x in rows for j, y in rows if i < j and (x ^ y).bit_count() <= 2], range(len(rows)))
    assert len(set(want.values())) < len(rows) - 10
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    got = near_copies.by_fingerprints(spark.createDataFrame(signed, "row long, fp long"))
    assert closure([(r.a, r.b) for r in got.collect()], range(len(rows))) == want

    asked = []
    monkeypatch.setattr(near_copies, "by_fingerprints", lambda x: asked.append(x.columns) or got.where("false"))
    stay = {rows[i][0] for i in brute(list(enumerate(texts)))}
    assert {r.doc_id for r in stages.simhash_near_dedup(spark, table(spark, list(enumerate(texts))), "").collect()} == stay
    assert asked == [["row", "fp"]]


def test_a_fingerprint_alone_links_nothing(spark):
    line = "the same five words again and again "
    texts = [line * 300 + " ".join(f"{c}{i}" for i in range(60)) for c in "ab"]  # one fingerprint, few shingles in common
    assert (simhash.fingerprint(texts[0].encode(), 5) ^ simhash.fingerprint(texts[1].encode(), 5)).bit_count() <= 2
    assert stages.simhash_near_dedup(spark, table(spark, list(enumerate(texts))), "").count() == 2
