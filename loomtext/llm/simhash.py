"""Near duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes
(seed 42) of a text's word shingles, repeats included. Two fingerprints link when
they differ in at most `radius` = 2 bits.

Search: a fingerprint is cut into two segments of 32 bits. Where two fingerprints
differ in at most two bits, one of the segments differs in at most one, so the two
share a one-wildcard variant of that segment: 32 variants for each of two segments
are indexed as 64-bit keys, equal keys are joined, and pairs are verified on the
whole fingerprint.

Rows with the same fingerprint are first brought down to one, so groups of copies of
any size are one row in the search. A key that more than `bucket` distinct
fingerprints share would make a square of pairs; its members leave the pair join and
take an exact way in linear space instead: each sends the 65 values within one bit
of itself, and those that share a value are within two bits of each other. Such a
group has at most 65 members and is linked through its least one. Two fingerprints
within two bits always share such a value, so no link is lost.

Keys are counted with map-side aggregation. A key of two fingerprints carries the pair
in its least and greatest value; members of keys with more are made once more, behind a
bitmap of fixed size, so that only they are shuffled again.

Components come from star rounds over a written edge table. Nothing is gathered to
the driver.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased.
Fewer words than the shingle size make one shingle of all words; no words (null or
empty text) give fingerprint zero, which links like any other. Rows that repeat a
doc_id are in one component only if their fingerprints are. Other columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, renamed, scope
from .graph import connected_components

SHINGLE_WORDS = 3
BUCKET = 24
FILTER_BITS = 1 << 26


def fingerprint(raw: bytes | None, shingle: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash64(b" ".join(words), seed)]
    else:
        parts = [words[i : len(words) - shingle + 1 + i] for i in range(shingle)]
        hashes = [hash64(s, seed) for s in map(b" ".join, zip(*parts))]
    ones = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(every), 65536):  # bounds the memory for very long texts
        ones += np.unpackbits(every[at : at + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column("_raw")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("_raw")).mapInArrow(run, f"doc_id {kind}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): segment number, wildcard position and the segment without that bit."""
    spread = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    return spread.select(
        F.expr(
            "(cast(k as bigint) << 32) | (((fp >>> (32 * (k div 32))) & 4294967295L)"
            " & (4294967295L ^ (1L << cast(k % 32 as int))))"
        ).alias("key"),
        "fp",
    )


def _slot(key: Column) -> Column:
    """A place in the filter for a key; _shared() computes the same."""
    segment, k = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32)
    return segment.bitwiseXOR(F.shiftrightunsigned(segment, 13)).bitwiseXOR(F.shiftleft(k, 20)).bitwiseAND(F.lit(FILTER_BITS - 1))


def _filter(keys: DataFrame) -> bytes:
    """A bitmap of fixed size, whatever the number of keys: at most 8 MB, in 4 KB rows."""
    slot = _slot(F.col("key")) + 1
    rows = (
        keys.select(slot.alias("slot"))
        .groupBy(F.expr("bitmap_bucket_number(slot)").alias("block"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
        .collect()
    )
    bits = bytearray(FILTER_BITS // 8)
    for row in rows:
        bits[(row["block"] - 1) * 4096 : row["block"] * 4096] = bytes(row["bits"])
    return bytes(bits)


def _shared(fps: DataFrame, bits: bytes) -> DataFrame:
    """The variants (key, fp) whose key may be in the filter; the others go unshuffled."""
    held = fps.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(64):
                segment = (fp >> np.uint64(32 * (k // 32))) & np.uint64(0xFFFFFFFF & ~(1 << k % 32))
                slot = (segment ^ (segment >> np.uint64(13)) ^ np.uint64(k << 20)) & np.uint64(FILTER_BITS - 1)
                hit = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if hit.any():
                    key = (segment[hit] | np.uint64(k << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[hit].view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose closure links all distinct fp within two bits of each other."""
    # few bytes a row, but 64 variants of each: spread them over many small tasks
    fps = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = materialize(
        _variants(fps).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"),
        "simhash-keys",
    )
    near = F.expr("bit_count(a ^ b) <= 2")
    two = groups.where("n = 2").where(near).select("a", "b").distinct()
    shared = groups.where("n > 2").select(F.col("key").alias("k"), "n")
    more = materialize(
        _shared(fps, _filter(shared.select(F.col("k").alias("key")))).join(shared, F.col("key") == F.col("k")).select("key", "fp", "n"),
        "simhash-members",
    )
    warm = more.where(F.col("n") <= bucket)
    pairs = (
        warm.select("key", F.col("fp").alias("a"))
        .join(warm.select(F.col("key").alias("k"), F.col("fp").alias("b")), (F.col("key") == F.col("k")) & F.col("a").__lt__(F.col("b")) & near)
        .select("a", "b")
        .distinct()
    )
    hot = more.where(F.col("n") > bucket).select("fp").distinct()
    ball = hot.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("k")).select(
        "fp", F.expr("CASE WHEN k < 0 THEN fp ELSE fp ^ (1L << k) END").alias("z")
    )
    met = ball.groupBy("z").agg(F.collect_set("fp").alias("near")).where("size(near) > 1")  # 65 at most, by construction
    stars = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()
    return two.union(pairs).union(stars)


def components(docs: DataFrame, *, shingle: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach, itself included."""
    rows = materialize(fingerprints(docs, shingle), "simhash-rows")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    parts = connected_components(links(fps.select("fp"), bucket))
    inner = fps.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    inner = materialize(inner, "simhash-roots")
    least = inner.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    of = inner.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return rows.join(of, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, *, shingle: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """The row with the smallest doc_id of each component; all columns stay.

    A null doc_id stays only where its component has no other. Rows are numbered in a
    written table, so that rows which share a doc_id are dropped each for itself.
    """
    doc, text = docs.columns.index("doc_id"), docs.columns.index("text")
    held = numbered(docs, "simhash-held")
    with scope(docs.sparkSession):
        parts = components(held.select(F.col("row").alias("doc_id"), F.col(f"c{text}").alias("text")), shingle=shingle, bucket=bucket)
        parts = parts.select(F.col("doc_id").alias("r"), F.col("component_id").alias("root"))
        ids = held.select("row", F.col(f"c{doc}").alias("id"))
        inner = materialize(ids.join(parts, F.col("row") == F.col("r")).select("row", "id", "root"), "simhash-inner")
        best = inner.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
        dropped = inner.select("row").join(best.select(F.col("best.row").alias("row")), "row", "left_anti")
        dropped = materialize(dropped, "simhash-dropped", outer=True)
    return renamed(held.join(dropped, "row", "left_anti"), docs.columns)
