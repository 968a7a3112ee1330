"""Near copies by SimHash fingerprints, completed by exact Jaccard similarity of word shingles.

A text is the set of its shingles of five words, as 64-bit hashes; words are those of the
SimHash operator. Two rows link when the similarity of their sets is 0.8 or more, and a
group is whatever links reach. Fewer words than the shingle size make one shingle of all;
texts without words are equal.

Search: first by the method of the SimHash operator. Every text has a fingerprint of its
shingles; rows with one fingerprint, and fingerprints within two bits by deletion variants,
are candidates, of which those with the similarity link. Most pairs of similarity 0.8 are
about ten bits apart, which variants do not reach, so an exact search finds the others; what
fingerprints have connected is not verified there again.

The exact search: with one order of all shingles, sets of similarity 0.8 share one of the first
n - ceil(0.8 n) + 1 shingles of each. These prefixes are indexed, so no link is lost.
Any order does; rare shingles come first, by counts in a tenth of the rows, of which the
`COMMON_SHINGLES` most frequent are sent; that only bears on the work and never on the
result. Where the first shared shingle of two sets stands also bounds what they can share
from there on, so a pair counts only by keys that stand early enough in both.

Keys of up to `bucket` rows are paired. A larger key takes pivots: in a round every row
meets the key's least one, and rows that link to it leave. Jaccard distance is a metric, so
a row that stays can link to one that left only if it is at most twice the limit from the
pivot. Such a row meets the rows that left with that pivot, once for all keys, and only if
no links found so far connect it with them; what is left after `rounds` pivots meets within
its key in the same way. They meet in blocks of `BLOCK` rows that hold sketches, and only
pairs that pass come out, so a group of many near copies makes no rows for all its pairs.

A sketch is the parity of the hashes in each of about four bins a shingle. Bins in which
two sketches differ are at most as many as the shingles that only one of the sets has, so
a pair with too many cannot link. All that pass are verified on whole sets.

Rows are numbered in a written table, so that only a row itself is dropped, whatever
doc_ids repeat or are null. The row with the smallest doc_id of a group stays, one with a
null doc_id only if there is no other. Null and empty texts have no words. Other columns
are carried as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, materialize, numbered, renamed, scope, setting
from .graph import connected_components
from .simhash import _filter, fingerprint
from .simhash import links as fingerprint_links

SHINGLE_WORDS = 5
BUCKET = 24
ROUNDS = 4
BLOCK = 64
SAMPLE_SHARE = 0.1
COMMON_SHINGLES = 300_000
#: i shared shingles of sets of m and n give a similarity of 0.8 or more.
LINKED = "9 * i >= 4 * (m + n)"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """XXH64 (seed 42) of words, kept while they are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_hashes = _Hashes()


def shingles(raw: bytes | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted set of a UTF-8 text's shingles; at least one."""
    words = (raw or b"").lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.full(max(1, len(words) - shingle + 1), len(words) < shingle, np.uint64)
    for i in range(width):
        out = out * _ODD + h[i : len(h) - width + 1 + i]
    out = (out ^ (out >> np.uint64(29))) * _ODD
    return np.unique(out ^ (out >> np.uint64(32)))


def sketch(s: np.ndarray) -> bytes:
    """The parities of a set's hashes in bins, four for each hash at least."""
    bins = 1 << max(6, (4 * len(s) - 1).bit_length())
    parity = np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def apart(x: tuple[int, int], y: tuple[int, int]) -> int:
    """At least as many shingles as only one of two sets has, from (bits, number of bins) of each."""
    (a, m), (b, n) = x, y
    while m > n:
        m //= 2
        a = (a >> m) ^ (a & ((1 << m) - 1))
    while n > m:
        n //= 2
        b = (b >> n) ^ (b & ((1 << n) - 1))
    return (a ^ b).bit_count()


def _bits(x: bytes) -> tuple[int, int]:
    return int.from_bytes(x, "little"), 8 * len(x)


def _slots(keys: np.ndarray) -> np.ndarray:
    """Places in the filter of simhash._filter()."""
    segment, k = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
    return (segment ^ (segment >> np.uint64(13)) ^ (k << np.uint64(20))) & np.uint64((1 << 26) - 1)


def _held(bits: bytes, keys: np.ndarray) -> np.ndarray:
    slot = _slots(keys)
    return (np.frombuffer(bits, np.uint8)[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _lists(arrays: list) -> pa.ListArray:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _sets(held: DataFrame, shingle: int, bits: bytes | None = None) -> DataFrame:
    """(row, set), of the rows in the filter if one is given."""
    sent = held.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("near_copies", _hashes.clear)
        for batch in batches:
            take = np.ones(batch.num_rows, bool) if sent.value is None else _held(sent.value, batch.column(0).to_numpy().view(np.uint64))
            some = batch.filter(pa.array(take))
            yield pa.RecordBatch.from_arrays([some.column(0), _lists([shingles(raw.as_py(), shingle) for raw in some.column(1)])], names=["row", "set"])

    return held.mapInArrow(run, "row long, set array<long>")


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of rows, sorted, and their counts."""
    sample = texts.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_SHARE))
    counts = _sets(sample, shingle).select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    got = counts.orderBy(F.desc("c"), "s").limit(COMMON_SHINGLES).toArrow()
    keys, seen = got.column("s").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], seen[order]


def _prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int) -> DataFrame:
    """(row, n, keys, bits, fp): the size of the set, its first shingles in the common order, its sketch, the text's fingerprint."""
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("near_copies", _hashes.clear)
        keys, seen = sent.value
        for batch in batches:
            sizes, first, bits, fps = [], [], [], np.zeros(batch.num_rows, np.uint64)
            for i, raw in enumerate(batch.column(1)):
                text = raw.as_py()
                fps[i] = fingerprint(text, shingle)
                s = shingles(text, shingle)
                n = len(s)
                bits.append(sketch(s))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    s = s[np.argsort(np.where(keys[at] == s, seen[at], 0), kind="stable")]
                sizes.append(n)
                first.append(s[: n - (4 * n + 4) // 5 + 1])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), _lists(first), pa.array(bits, pa.binary()), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "keys", "bits", "fp"])

    return texts.mapInArrow(run, "row long, n long, keys array<long>, bits binary, fp long")


def by_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows whose closure links all (row, fp) with fingerprints within two bits of each other."""
    fps = materialize(rows.groupBy("fp").agg(F.min("row").alias("least")), "near-fps")
    ends = fps.select(F.col("fp").alias("f"), "least")
    same = rows.join(ends, F.col("fp") == F.col("f")).where("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b"))
    near = fingerprint_links(fps.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    near = near.join(ends.select(F.col("f").alias("x"), F.col("least").alias("a")), "x").join(ends.select(F.col("f").alias("y"), F.col("least").alias("b")), "y")
    return materialize(same.union(near.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "near-fingerprints")


def _members(prefixes: DataFrame, bits: bytes) -> DataFrame:
    """(key, row, n, at) of the keys that may be in the filter, with their places; the others go unshuffled."""
    sent = prefixes.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy().view(np.uint64)
            sizes = lists.value_lengths().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = _held(sent.value, keys)
            rows, sizes = batch.column("row").to_numpy(), batch.column("n").to_numpy()
            columns = [keys[hit].view(np.int64), rows[of[hit]], sizes[of[hit]], place[hit].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "row", "n", "at"])

    return prefixes.select("row", "n", "keys").mapInArrow(run, "key long, row long, n long, at long")


def _judged(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b, link, near): the distinct pairs that may have a similarity of 0.6 (near), and of 0.8 (link), by their sketches."""
    left = marks.select(F.col("row").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    right = marks.select(F.col("row").alias("b"), "n", F.col("bits").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [apart(_bits(x), _bits(y)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            both = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            link, near = 9 * np.array(d, np.int64) <= both, 4 * np.array(d, np.int64) <= both
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link), pa.array(near)], names=["a", "b", "link", "near"])
            yield out.filter(pa.array(near))

    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    return materialize(both.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long, link boolean, near boolean"), "near-judged")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose whole sets have the similarity.

    Sets travel to their pair, and a pair has two, so no row of many pairs is a hot key.
    """
    asked = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("r"))
    both = asked.join(sets, F.col("r") == F.col("row")).groupBy("a", "b").agg(F.collect_list("set").alias("s"))
    x, y = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    sizes = both.select("a", "b", F.size(F.array_intersect(x, y)).cast("long").alias("i"), F.size(x).cast("long").alias("m"), F.size(y).cast("long").alias("n"))
    return materialize(sizes.where(LINKED).select("a", "b"), "near-links")


def _met(left: DataFrame, right: DataFrame, marks: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of left and right in one group (g, row) that may link and are not connected.

    Both sides are dealt into blocks, and every block of the left meets every one of the right.
    """

    def blocks(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.distinct()
        held = materialize(
            rows.join(marks, "row").join(roots, F.col("row") == F.col("node"), "left").select("g", "row", "n", "bits", F.coalesce("root", "row").alias("root")),
            f"near-{tag}",
        )
        counts = held.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{tag}s"))
        dealt = held.join(counts, "g").select("g", F.pmod(F.xxhash64("row"), F.col(f"{tag}s")).cast("int").alias(tag), "row", "n", "bits", "root")
        each = F.collect_list(F.struct("row", "n", "bits", "root"))
        return dealt.groupBy("g", tag).agg(each.alias(f"{tag}rows")), counts

    (one, _), (two, counts) = blocks(left, "i"), blocks(right, "j")
    asked = one.join(counts, "g").select("g", "irows", F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(rows: list) -> list:
            return [(r["row"], r["n"], _bits(r["bits"]), r["root"]) for r in rows]

        for batch in batches:
            for i in range(batch.num_rows):
                a, b = read(batch.column(0)[i].as_py()), read(batch.column(1)[i].as_py())
                got = [
                    (min(r, s), max(r, s))
                    for r, m, x, p in a
                    for s, n, y, q in b
                    if p != q and 5 * min(m, n) >= 4 * max(m, n) and 9 * apart(x, y) <= m + n
                ]
                columns = list(zip(*got)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    pairs = asked.join(two, ["g", "j"]).select("irows", "jrows").mapInArrow(run, "a long, b long")
    with setting(marks.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "64"):  # rows of two blocks are large
        return materialize(pairs.distinct(), "near-met")


def _unconnected(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose rows the links found do not connect."""
    if found.isEmpty():
        return pairs
    of = materialize(connected_components(found), "near-first")
    ends = pairs.join(of.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    return ends.where("x IS NULL OR y IS NULL OR x <> y").select("a", "b")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _hot(hot: DataFrame, marks: DataFrame, sets: DataFrame, found: list[DataFrame], rounds: int) -> list[DataFrame]:
    """Links of the keys with many rows; found are those of the others."""
    stars, near = [], []
    for _ in range(rounds):
        if hot.isEmpty():
            break
        pivots = hot.groupBy("key").agg(F.min("row").alias("p")).select(F.col("key").alias("k"), "p")
        to = materialize(hot.join(pivots, F.col("key") == F.col("k")).where("row <> p").select("key", "row", "p"), "near-pivots")
        judged = _judged(to.select(F.col("row").alias("a"), F.col("p").alias("b")), marks)
        links = _linked(judged.where("link"), sets)
        left = links.select("a", "b").withColumn("left", F.lit(True))
        hot = materialize(
            to.join(left, (F.col("row") == F.col("a")) & (F.col("p") == F.col("b")), "left").where("left IS NULL").select("key", "row"), "near-hot"
        )
        stars.append(links)
        near.append(judged.select("a", "b"))
    roots = materialize(connected_components(_union(found + stars)), "near-roots")
    rest = hot.select(F.col("key").alias("g"), "row")
    met = _met(rest, rest, marks, roots)
    if stars:
        # (p, row): rows near a pivot that no links connect with it, and the rows linked to it
        of = roots.select(F.col("node").alias("v"), F.col("root").alias("of"))
        both = _union(near).distinct().join(of, F.col("b") == F.col("v"))
        outside = both.join(roots, F.col("a") == F.col("node"), "left").where("root IS NULL OR root <> of").select(F.col("b").alias("g"), F.col("a").alias("row"))
        met = met.union(_met(outside, _union(stars).select(F.col("b").alias("g"), F.col("a").alias("row")), marks, roots))
    return [*stars, _linked(met.distinct(), sets)]


def links(texts: DataFrame, *, shingle: int = SHINGLE_WORDS, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) between rows whose closure links all rows of similarity 0.8 or more. texts: (row, text as binary)."""
    prefixes = materialize(_prefixes(texts, _common(texts, shingle), shingle), "near-prefixes")
    groups = materialize(
        prefixes.select("row", F.explode("keys").alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("c"), F.min("row").alias("a"), F.max("row").alias("b"))
        .where("c > 1"),
        "near-keys",
    )
    two = groups.where("c = 2").select("a", "b")
    shared = groups.where("c > 2").select(F.col("key").alias("k"), "c")
    more = materialize(
        _members(prefixes, _filter(shared.select(F.col("k").alias("key")))).join(shared, F.col("key") == F.col("k")).select("key", "row", "n", "at", "c"),
        "near-members",
    )
    warm, hot = more.where(F.col("c") <= bucket), more.where(F.col("c") > bucket).select("key", "row")
    # 9 i >= 4 (m + n) with at most as many shared ones as stand from the key on in either set
    early = (9 * (F.col("m") - F.col("p")) >= 4 * (F.col("m") + F.col("n"))) & (9 * (F.col("n") - F.col("at")) >= 4 * (F.col("m") + F.col("n")))
    other = warm.select(F.col("key").alias("k"), F.col("row").alias("b"), "n", "at")
    mine = warm.select("key", F.col("row").alias("a"), F.col("n").alias("m"), F.col("at").alias("p"))
    pairs = mine.join(other, (F.col("key") == F.col("k")) & (F.col("a") < F.col("b")) & early).select("a", "b")
    marks = prefixes.select("row", "n", "bits")
    close = _judged(by_fingerprints(prefixes.select("row", "fp")), marks).where("link")
    judged = _judged(two.union(pairs), marks).where("link")
    rows = close.union(judged).select(F.explode(F.array("a", "b")).alias("key")).union(hot.select("row")).distinct()
    sets = materialize(_sets(texts, shingle, _filter(rows)), "near-sets")
    first = _linked(close, sets)
    found = [first, _linked(_unconnected(judged, first), sets)]
    return _union(found if hot.isEmpty() else found + _hot(hot, marks, sets, found, rounds))


def dedup(docs: DataFrame, *, shingle: int = SHINGLE_WORDS, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """The documents without the rows that have a near copy with a smaller doc_id; all columns stay."""
    doc, text = docs.columns.index("doc_id"), docs.columns.index("text")
    held = numbered(docs, "near-rows")
    texts = held.select("row", F.col(f"c{text}").cast("binary").alias("raw"))
    with scope(docs.sparkSession):
        parts = materialize(connected_components(links(texts, shingle=shingle, bucket=bucket, rounds=rounds)), "near-parts")
        ids = held.select("row", F.col(f"c{doc}").alias("id"))
        inner = materialize(ids.join(parts, F.col("row") == F.col("node")).select("row", "id", "root"), "near-inner")
        best = inner.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
        best = best.select(F.col("best.row").alias("row"))
        dropped = materialize(inner.select("row").join(best, "row", "left_anti").distinct(), "near-dropped", outer=True)
    # a plain exchange on either side, so that the output comes in partitions of a fair size for packing
    return renamed(held.join(dropped.hint("merge"), "row", "left_anti"), docs.columns)
