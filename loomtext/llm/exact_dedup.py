"""Exact duplicates by progressive refinement.

Texts are equal when identical after lower-casing A-Z. Candidates are narrowed in
steps: byte length, then the hash of a short prefix, then the SHA-256 of the whole
text, which is computed only where length and prefix are shared. Two scans do it:
the first yields length and prefix hash together, because Parquet gives a prefix
only with the whole value; the second hashes whole texts of the survivors. The
survivors reach the second scan as a bitmap of fixed size (`filter_bits`), so what
is sent to executors never grows with the data; a collision in it costs one more
hash and never changes the result.

Only keys are shuffled, never texts. A group of copies that holds a large share of
the rows is counted with map-side partial aggregation and joined back with an
ordinary equi-join, which adaptive execution splits when skewed.

Defined results: null text counts as empty, and empty texts are equal. Of equal
texts the largest doc_id stays (a null doc_id only if there is no other). Rows that
repeat a doc_id and its text count in group_size and exactly one of them is kept.
Other columns, whatever their names, are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PREFIX_BYTES = 512
FILTER_BITS = 1 << 23
_BLOCK = 32768  # bits in one bitmap of bitmap_construct_agg


def _probe(raw: bytes, bits: int) -> tuple[int, int, int]:
    """Length, prefix hash and filter slot of a normalised text."""
    n = len(raw)
    prefix = xxhash.xxh64_intdigest(raw[:PREFIX_BYTES])
    slot = xxhash.xxh64_intdigest(n.to_bytes(8, "little") + prefix.to_bytes(8, "little"), 7) % bits
    return n, prefix, slot


def _texts(column: pa.Array) -> Iterator[bytes]:
    for raw in column.cast(pa.binary()):  # a view of the same bytes
        yield (raw.as_py() or b"").lower()


def shared_slots(docs: DataFrame, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """The bitmap of (length, prefix hash) pairs that two or more rows share."""
    schema = pa.schema([("n_bytes", pa.int64()), ("prefix", pa.int64()), ("slot", pa.int64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_probe(raw, filter_bits) for raw in _texts(batch.column(0))]
            n, p, s = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(np.array(p, np.uint64).view(np.int64)), pa.array(s, pa.int64())],
                schema=schema,
            )

    rows = docs.select("text").mapInArrow(probe, "n_bytes long, prefix long, slot long")
    pairs = rows.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n"), F.min("slot").alias("slot"))
    blocks = (
        pairs.where("n > 1")
        .groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("block"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
        .collect()  # at most filter_bits / 32768 rows of 4 KB, whatever the input
    )
    bitmap = np.zeros(filter_bits, np.uint8)
    for row in blocks:
        # buckets are numbered from 1; the value 1 is the first bit of the first
        at = (row["block"] - 1) * _BLOCK
        part = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        take = min(_BLOCK, filter_bits - at)
        bitmap[at : at + take] = part[:take]
    return np.packbits(bitmap, bitorder="little")


def keyed(docs: DataFrame, slots: np.ndarray, *, digest_all: bool = False, carry: bool = False) -> DataFrame:
    """A key per row, `_key`, that equal texts, and no others, share.

    The key is the SHA-256 of the normalised text for survivors of the length and
    prefix steps, else length and prefix hash, which no other row has. slots come from
    shared_slots() over the same rows. digest_all adds `_sha`, the SHA-256 for every
    row. The other columns are c0, the doc_id, or with carry c0, c1, ... for all input
    columns in their order, so that no input name can clash.
    """
    held = docs.sparkSession.sparkContext.broadcast(slots.tobytes())
    filter_bits = 8 * len(slots)
    taken = docs.columns if carry else ["doc_id", "text"]
    text = taken.index("text")
    out = [i for i in range(len(taken)) if carry or i != text]
    out_names = [f"c{i}" for i in out] + ["_key"] + (["_sha"] if digest_all else [])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            keys, shas = [], []
            for raw in _texts(batch.column(text)):
                n, prefix, slot = _probe(raw, filter_bits)
                sha = None
                if hit[slot >> 3] >> (slot & 7) & 1:
                    sha = hashlib.sha256(raw).hexdigest()
                keys.append(sha or f"{n:x}-{prefix:016x}")
                if digest_all:
                    shas.append(sha or hashlib.sha256(raw).hexdigest())
            columns = [batch.column(i) for i in out] + [pa.array(keys, pa.string())]
            if digest_all:
                columns.append(pa.array(shas, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=out_names)

    kinds = [docs.schema[taken[i]].dataType.simpleString() for i in out] + ["string", "string"]
    source = docs.select(*[F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(taken)])
    return source.mapInArrow(digest, ", ".join(f"{name} {kind}" for name, kind in zip(out_names, kinds, strict=False)))


def mark(docs: DataFrame, *, filter_bits: int = FILTER_BITS, digest_all: bool = False, slots: np.ndarray | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and its key."""
    slots = shared_slots(docs, filter_bits) if slots is None else slots
    rows = materialize(
        keyed(docs, slots, digest_all=digest_all)
        .withColumnRenamed("c0", "doc_id")
        .withColumn("_row", F.monotonically_increasing_id()),
        "exact-keys",
    )
    # written, so that the join below has a plain exchange on either side, which can be split where skewed
    groups = materialize(
        rows.groupBy("_key")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "_row")).alias("best"))
        .where("n > 1")
        .select(F.col("_key").alias("k"), "n", "best"),
        "exact-groups",
    )
    alone = F.col("best").isNull()
    return rows.join(groups, F.col("_key") == F.col("k"), "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best._row") == F.col("_row"))).alias("kept"),
        *([F.col("_sha").alias("text_sha256")] if digest_all else []),
        "_key",
    )


def dedup(docs: DataFrame, *, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents without the rows that mark() drops; all columns stay."""
    slots = shared_slots(docs, filter_bits)
    marks = materialize(mark(docs, slots=slots), "exact-marks")
    dropped = marks.where("NOT kept AND doc_id IS DISTINCT FROM keep_id").select(
        F.col("doc_id").alias("_d"), F.col("_key").alias("_k")
    )
    again = marks.where("NOT kept AND doc_id IS NOT DISTINCT FROM keep_id").select(
        F.col("doc_id").alias("_d"), F.col("_key").alias("_k")
    )
    rows = keyed(docs, slots, carry=True)
    doc = f"c{docs.columns.index('doc_id')}"
    same = (F.col("_key") == F.col("_k")) & F.col(doc).eqNullSafe(F.col("_d"))
    left = rows.join(dropped, same, "left_anti")
    if not again.isEmpty():  # rows that repeat a doc_id with its text
        again = again.distinct()
        left = left.join(again, same, "left_anti").unionByName(
            left.join(again, same, "left_semi").dropDuplicates([doc, "_key"])
        )
    return left.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
