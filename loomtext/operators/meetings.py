"""Meetings of names in shared scenes, counted by blocks of names.

A join of the names of a scene makes a row for every pair and scene. Where that is far more
than the rows there are, names are dealt into blocks; each two blocks meet in one task, which
counts all their pairs as a product of matrices (or by expanding scenes, where those hold few
of the names) and gives out what is asked: pairs, counts of partners or the best partners.
Nothing is dropped, and no pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _checkpointed

#: Names and entries (scenes of a name) of a block, on average at most.
NAMES, ENTRIES = 4096, 250_000
#: Rows of a product that are held at once, scenes of a dense slice, pairs expanded at once.
ROWS, SCENES, EXPANDED = 1024, 2048, 4_000_000
#: A product is dense where it has at most so many multiplications for each pair that meets.
DENSE = 100
#: Up to so many rows a join is the plainer way.
JOINED = 20_000_000


def together(did: DataFrame, there: DataFrame) -> DataFrame:
    """(s, n, acts, there) of did (s, n, acts) and there (s, n): acts of a name in a scene, and 1 if it is one of its names."""
    both = did.select("s", "n", "acts", F.lit(0).alias("there")).union(there.select("s", "n", F.lit(0).cast("long"), F.lit(1)))
    return both.where("s IS NOT NULL AND n IS NOT NULL").groupBy("s", "n").agg(F.sum("acts").alias("acts"), F.max("there").alias("there"))


def blocks_for(rows: DataFrame, joined: int = JOINED, names: int = NAMES) -> int:
    """How many blocks the names of (s, n, acts, there) take, or 0 if a join does with few enough rows."""
    scenes = rows.groupBy("s").agg(F.sum((F.col("acts") > 0).cast("double")).alias("d"), F.sum(F.col("there").cast("double")).alias("t"), F.count("*").alias("e"))
    sums = scenes.agg(F.sum(F.col("t") * F.greatest("d", "t")).alias("pairs"), F.sum("e").alias("entries")).first()
    if not sums["pairs"] or sums["pairs"] <= joined:
        return 0
    count = rows.select("n").distinct().count()
    n = max(-(-count // names), -(-sums["entries"] // ENTRIES))
    return n if joined <= 0 or sums["pairs"] > 4 * n * sums["entries"] else 0


def _blocks(rows: DataFrame, n: int, values: tuple[str, str]) -> DataFrame:
    """(block, names, sizes, scenes and the values asked for): a row for each block; names in order, their scenes one after another."""
    kinds = {c: kind for c, kind in (("acts", "array<bigint>"), ("there", "array<tinyint>")) if c in values}
    if rows.schema["s"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("s", F.col("s").cast("long"))
    else:  # scenes get numbers, fixed by the checkpoint
        numbers = _checkpointed(rows.select("s").distinct().select("s", F.monotonically_increasing_id().alias("number")))
        rows = rows.join(numbers, "s").select(F.col("number").alias("s"), "n", "acts", "there")
    own = rows.groupBy("n").agg(F.collect_list(F.struct("s", "acts", "there")).alias("e"))
    held = own.groupBy(F.pmod(F.xxhash64("n"), F.lit(n)).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("x"))
    flat = F.flatten(F.transform("x", lambda r: r["e"]))
    held = held.select("block", F.transform("x", lambda r: r["n"]).alias("names"), F.transform("x", lambda r: F.size(r["e"])).alias("sizes"), flat.alias("e"))
    return _checkpointed(held.select("block", "names", "sizes", F.col("e.s").alias("scenes"), *[F.col(f"e.{c}").cast(kind).alias(c) for c, kind in kinds.items()]))


class Block:
    """Entries (scene, name, value) of one side, those of no value left out."""

    def __init__(self, row: dict, value: str):
        self.names = row["names"]
        name = np.repeat(np.arange(len(self.names)), row["sizes"])
        keep = row[value] > 0
        self.name, self.scene, self.value = name[keep], row["scenes"][keep], row[value][keep]


def product(x: Block, y: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(first, counts): for slices of the names of x, the sums over scenes of values of x times those of y."""
    common = np.intersect1d(x.scene, y.scene)

    def side(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, b.scene), max(0, len(common) - 1))
        keep = common[at] == b.scene if len(common) else np.zeros(len(b.scene), bool)
        order = np.argsort(at[keep], kind="stable")
        return at[keep][order], b.name[keep][order], b.value[keep][order]

    (xs, xn, xv), (ys, yn, yv) = side(x), side(y)
    width = len(y.names)
    most = np.bincount(xn, xv, 1).max() * (yv.max() if len(yv) else 0)
    kind = np.float32 if most < 1 << 24 else np.float64
    low, high = np.searchsorted(ys, xs), np.searchsorted(ys, xs, side="right")
    for first in range(0, len(x.names), ROWS):
        rows = min(ROWS, len(x.names) - first)
        mine = np.flatnonzero((xn >= first) & (xn < first + rows))
        s, n, v, meets = xs[mine], xn[mine] - first, xv[mine], high[mine] - low[mine]
        out = np.zeros((rows, width), kind)
        if len(common) * rows * width <= DENSE * meets.sum():
            for c in range(0, len(common), SCENES):
                size = min(SCENES, len(common) - c)
                left, right = np.zeros((rows, size), kind), np.zeros((size, width), kind)
                a, b = np.searchsorted(s, [c, c + size])
                left[n[a:b], s[a:b] - c] = v[a:b]
                a, b = np.searchsorted(ys, [c, c + size])
                right[ys[a:b] - c, yn[a:b]] = yv[a:b]
                out += left @ right
        else:
            flat, total = out.reshape(-1), np.cumsum(meets)
            a = 0
            while a < len(mine):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + EXPANDED, side="right")))
                m = meets[a:b]
                of = np.repeat(np.arange(a, b), m)
                there = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[mine[a:b]], m)
                np.add.at(flat, n[of] * width + yn[there], (v[of] * yv[there]).astype(kind))
                a = b
        yield first, out


def _run(rows: DataFrame, n: int, ordered: bool, values: tuple[str, str], give: Callable, ddl: str) -> DataFrame:
    """What give(x, y, same, first, counts) yields for every two blocks; each two once unless ordered."""
    held = _blocks(rows, n, values)
    right = held.select(F.col("block").alias("j"), *[F.col(c).alias(f"y_{c}") for c in held.columns[1:]])
    start = F.lit(0) if ordered else F.col("block")
    left = held.select(F.col("block").alias("i"), *[F.col(c).alias(f"x_{c}") for c in held.columns[1:]], F.explode(F.sequence(start, F.lit(n - 1))).alias("j"))
    pairs = left.join(right.hint("shuffle_hash"), "j").repartition(min(4096, n * n if ordered else n * (n + 1) // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for side, value in zip("xy", values):
                    of = {c: batch.column(f"{side}_{c}")[k].values for c in ("names", "sizes", "scenes", value)}
                    sides.append(Block({c: v if c == "names" else v.to_numpy() for c, v in of.items()}, value))
                same = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                for first, counts in product(*sides):
                    yield from give(*sides, same, first, counts)

    return pairs.mapInArrow(run, ddl)


def _out(names: list[str], columns: list, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), step):
        yield pa.RecordBatch.from_arrays([c.slice(at, step) for c in columns], names=names)


def _found(x: Block, y: Block, i: np.ndarray, j: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(i), 1 << 18):
        part = slice(at, at + (1 << 18))
        yield from _out(["a", "b", "n"], [x.names.take(pa.array(i[part])), y.names.take(pa.array(j[part])), pa.array(counts[part].astype(np.int64))])


def pairs(rows: DataFrame, n: int, least: int) -> DataFrame:
    """(a, b, weight), a < b: names that are together in at least so many scenes."""

    def give(x: Block, y: Block, same: bool, first: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(np.triu(counts >= max(1, least), first + 1) if same else counts >= max(1, least))
        yield from _found(x, y, i + first, j, counts[i, j])

    kind = rows.schema["n"].dataType.simpleString()
    out = _run(rows, n, False, ("there", "there"), give, f"a {kind}, b {kind}, n long")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("n").alias("weight"))


def partners(rows: DataFrame, n: int, least: int) -> DataFrame:
    """(name, degree): with how many others a name is together in at least so many scenes; no row for none."""

    def give(x: Block, y: Block, same: bool, first: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        hit = counts >= max(1, least)
        if same:
            at = np.arange(len(hit))
            hit[at, first + at] = False
        for of, names in [(hit.sum(1), x.names.slice(first, len(hit)))] + ([] if same else [(hit.sum(0), y.names)]):
            keep = of > 0
            yield from _out(["name", "n"], [names.filter(pa.array(keep)), pa.array(of[keep].astype(np.int64))])

    kind = rows.schema["n"].dataType.simpleString()
    out = _run(rows, n, False, ("there", "there"), give, f"name {kind}, n long")
    return out.groupBy("name").agg(F.sum("n").alias("degree"))


def directed(rows: DataFrame, n: int, best: int | None = None) -> DataFrame:
    """(actor, other, acts): acts of a name in scenes of another; of each actor and block only the `best`, if that is given.

    Among equal counts the lesser names are better.
    """

    def give(x: Block, y: Block, same: bool, first: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if same:
            at = np.arange(len(counts))
            counts[at, first + at] = 0
        if best is None or best >= counts.shape[1]:
            i, j = np.nonzero(counts)
        else:
            width = counts.shape[1]
            order = counts.astype(np.int64) * width + np.arange(width - 1, -1, -1)
            j = np.argpartition(order, width - best, axis=1)[:, width - best :].ravel()
            i = np.repeat(np.arange(len(counts)), best)
            keep = counts[i, j] > 0
            i, j = i[keep], j[keep]
        yield from _found(x, y, i + first, j, counts[i, j])

    kind = rows.schema["n"].dataType.simpleString()
    return _run(rows, n, True, ("acts", "there"), give, f"a {kind}, b {kind}, n long").select(F.col("a").alias("actor"), F.col("b").alias("other"), F.col("n").alias("acts"))
