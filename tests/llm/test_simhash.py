import random

import xxhash
from pyspark.sql import types as T

from loomtext.llm import simhash
from loomtext.llm.graph import connected_components

from .helpers import AWKWARD, table


def fingerprint(text, k=3):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", raw) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs_of, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs_of:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(fps):
    fps = sorted(set(fps))
    return closure([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2], fps)


def test_fingerprint_equals_bitwise_definition():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 7, 40, 300):
        text = " ".join(rng.choice(["Alpha", "béta", "Ü", "x", "y z"]) for _ in range(n)) + "\n"
        assert simhash.fingerprint(text.encode()) == fingerprint(text)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_links_lose_nothing_in_hot_buckets(spark):
    """Clouds of fingerprints around a few centres, far over the bucket limit."""
    rng = random.Random(11)
    fps = {0}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)} | {1, 3, 2**63, 2**63 | 2**31}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = brute_components([signed(x) for x in fps])
    for bucket in (2, 24):
        got = {x: x for x in want}
        got |= {r.node: r.root for r in connected_components(simhash.links(df, bucket)).collect()}
        assert got == want


def test_components_of_awkward_texts(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [r for r in AWKWARD if r[0] is not None] + [(50 + i, base.replace("w7 ", f"v{i} ")) for i in range(8)] + [(70, base)]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.components(table(spark, rows).repartition(3)).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    assert {i: fp for i, (fp, _) in got.items()} == fps
    roots = brute_components(fps.values())
    least = {}
    for i in sorted(fps):
        least.setdefault(roots[fps[i]], i)
    assert {i: c for i, (_, c) in got.items()} == {i: least[roots[fps[i]]] for i in fps}


def test_dedup_keeps_the_smallest_of_each_group(spark):
    docs = table(spark, [(9, "same text here"), (4, "same text here"), (5, "SAME text here"), (6, None), (7, ""), (8, "other words are these")])
    got = simhash.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [4, 6, 8]


def test_empty_table_and_long_chain(spark):
    assert simhash.components(table(spark, [])).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    assert {r.root for r in connected_components(chain).collect()} == {0}
    empty = spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    assert connected_components(empty).count() == 0
