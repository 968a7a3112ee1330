"""Scene segmentation: break signals as windows, packing as one ordered pass a chapter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V

#: sizes of blocks in paragraphs
LEAST, MOST = 8, 15


def dialogue_breaks(rows: DataFrame, keys: Sequence[str], order: str, dialogue: Column, run: int = 3) -> DataFrame:
    """rows with brk: a non-dialogue row right after at least `run` dialogue rows."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_d", dialogue)
    after = F.lit(True)
    for k in range(1, run + 1):
        after = after & F.coalesce(F.lag("_d", k).over(w), F.lit(False))
    return marked.withColumn("brk", ~F.col("_d") & after).drop("_d")


def rule_breaks(rows: DataFrame, keys: Sequence[str], order: str, dialogue: Column, signals: Sequence[str], text: str = "text", run: int = 3) -> DataFrame:
    """Dialogue breaks, or a line that opens with a signal; never the first row. block numbers the pieces."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = dialogue_breaks(rows, keys, order, dialogue, run)
    opens = X.starts_with_any(F.col(text), signals) if signals else F.lit(False)
    brk = (F.col("brk") | opens) & (F.row_number().over(w) > 1)
    marked = marked.withColumn("brk", brk)
    return marked.withColumn("block", F.sum(F.col("brk").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def cosine_breaks(rows: DataFrame, keys: Sequence[str], order: str, vec: str, threshold: float = 0.42) -> DataFrame:
    """rows with sim, the cosine to the row before, and brk where it is under the threshold."""
    before = F.lag(vec).over(W.partitionBy(*keys).orderBy(order) if keys else W.orderBy(order))
    sim = F.when(before.isNotNull() & F.col(vec).isNotNull(), V.cosine(before, F.col(vec)))
    return rows.withColumn("sim", sim).withColumn("brk", F.coalesce(sim < threshold, F.lit(False)))


# --- packing: plain functions over the blocks of one chapter --------------------------


def split_oversize(block: list, protected: bool, sim: Callable[[int], float | None] | None, least: int = LEAST, most: int = MOST) -> list[tuple[list, bool]]:
    """Cut a block until no piece is over the limit, at its weakest link where links are known.

    sim(i) is the similarity of the rows i - 1 and i of the block. Only the first piece
    keeps the protection.
    """
    if len(block) <= most:
        return [(block, protected)]
    if sim is None:
        cut = most
    else:
        links = [(sim(i), i) for i in range(least, len(block) - least)]
        known = [(s, i) for s, i in links if s is not None]
        cut = min(known)[1] if known else min(most, len(block) // 2) if links else len(block) // 2
    left = split_oversize(block[:cut], protected, sim, least, most)
    shifted = None if sim is None else lambda i: sim(i + cut)
    return left + split_oversize(block[cut:], False, shifted, least, most)


def merge_freely(blocks: list[list], switch: Callable[[list], bool], least: int = LEAST, most: int = MOST) -> list[list]:
    """Merge fragments, leftmost first, until none is left; then cut what grew too long.

    One that opens with a switch signal only joins what follows, if that fits. Others
    join what is before if it fits, else what follows, else what is before anyhow.
    """
    blocks = [list(b) for b in blocks]
    stuck: set[int] = set()
    while True:
        at = next((i for i, b in enumerate(blocks) if len(b) < least and id(b) not in stuck), None)
        if at is None or len(blocks) == 1:
            break
        b = blocks[at]
        fits = lambda j: 0 <= j < len(blocks) and len(blocks[j]) + len(b) <= most  # noqa: B023, E731
        if switch(b):
            if fits(at + 1):
                blocks[at : at + 2] = [b + blocks[at + 1]]
            else:
                stuck.add(id(b))
        elif fits(at - 1):
            blocks[at - 1 : at + 1] = [blocks[at - 1] + b]
        elif at + 1 < len(blocks):
            blocks[at : at + 2] = [b + blocks[at + 1]]
        else:
            blocks[at - 1 : at + 1] = [blocks[at - 1] + b]
    return [piece for b in blocks for piece, _ in split_oversize(b, False, None, least, most)]


def merge_additive(blocks: list[tuple[list, bool]], least: int = LEAST, most: int = MOST) -> list[list]:
    """Merge fragments only where the result fits: protected ones forward, others backward, else forward."""
    blocks = [(list(b), p) for b, p in blocks]
    i = 0
    while i < len(blocks):
        b, prot = blocks[i]
        if len(b) < least:
            if not prot and i > 0 and len(blocks[i - 1][0]) + len(b) <= most:
                blocks[i - 1 : i + 1] = [(blocks[i - 1][0] + b, blocks[i - 1][1])]
                i = max(0, i - 1)
                continue
            if i + 1 < len(blocks) and len(b) + len(blocks[i + 1][0]) <= most:
                blocks[i : i + 2] = [(b + blocks[i + 1][0], prot)]
                continue
        i += 1
    return [b for b, _ in blocks]


def pack_scenes(rows: DataFrame, keys: Sequence[str], order: str, *, switch: str | None = None, vec: str | None = None, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Scenes (keys, event_seq, start, end, size) of rows that carry block, from rule_breaks().

    One ordered pass per chapter, whose size is that of a chapter. switch names a boolean
    column: the row opens with a switch signal. With a vector column, blocks are cut at
    weakest links and merged only where they fit; without, by the rule for free merges.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    position = rows.schema[order].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        blocks = [list(g.index) for _, g in pdf.groupby("block", sort=True)]
        opens = (lambda b: bool(pdf[switch].iat[b[0]])) if switch else (lambda b: False)
        if vec is None:
            done = merge_freely(blocks, opens, least, most)
        else:
            vectors = pdf[vec].tolist()

            def link(a: int) -> float | None:
                u, v = vectors[a - 1], vectors[a]
                if u is None or v is None:
                    return None
                u, v = np.asarray(u, float), np.asarray(v, float)
                scale = float(np.linalg.norm(u) * np.linalg.norm(v))
                return float(u @ v) / scale if scale else 0.0

            pieces = [p for b in blocks for p in split_oversize(b, opens(b), lambda i, b=b: link(b[i]), least, most)]
            done = merge_additive(pieces, least, most)
        at = pdf[order].tolist()
        out = {k: [pdf[k].iat[0]] * len(done) for k in keys}
        out |= {"event_seq": range(1, len(done) + 1), "start": [at[b[0]] for b in done], "end": [at[b[-1]] for b in done], "size": [len(b) for b in done]}
        return pd.DataFrame(out)

    columns = [*keys, order, "block", *([switch] if switch else []), *([vec] if vec else [])]
    return rows.select(*columns).groupBy(*keys).applyInPandas(run, f"{kinds}, event_seq int, start {position}, end {position}, size long")


def normalise_bounds(count: int, suggested: Sequence[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends (exclusive) of blocks over `count` rows, cut at suggested starts of new blocks.

    From each start the last suggestion that gives a block of least..most rows wins, else
    the limit; a short tail joins the block before it if that fits.
    """
    ends, at = [], 0
    borders = sorted({s for s in suggested if 0 < s < count})
    while at < count:
        near = [s for s in borders if at + least <= s <= at + most]
        at = near[-1] if near and count - at > most else min(count, at + most)
        ends.append(at)
    if len(ends) > 1 and count - ends[-2] < least and count - (ends[-3] if len(ends) > 2 else 0) <= most:
        ends.pop(-2)
    return ends


def resolve_beats(paras: Sequence[str], anchors: Sequence[str], first: int = 1, head: int = 8) -> list[tuple[int, int, int]]:
    """(beat, start, end) of beats in a scene whose paragraphs are numbered from `first`.

    An anchor stands where its first characters are found; the others are spread evenly.
    Beats are sorted, one a start, with increasing starts, and end before the next one.
    """
    n, total = len(paras), max(1, len(anchors))
    found = []
    for k, anchor in enumerate(anchors):
        key = (anchor or "").strip()[:head]
        at = next((i for i, p in enumerate(paras) if key and key in p), None)
        found.append((k * n // total if at is None else at, k))
    starts, out = set(), []
    for at, k in sorted(found):
        if at not in starts:
            starts.add(at)
            out.append((at, k))
    return [(k, first + at, first + (out[i + 1][0] if i + 1 < len(out) else n) - 1) for i, (at, k) in enumerate(out)]


def chunk_by_budget(rows: DataFrame, keys: Sequence[str], order: str, size: str, *, max_rows: int = 8, max_size: int = 3000) -> DataFrame:
    """rows with chunk: a chunk closes once it has max_rows rows or max_size of size."""
    names = rows.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", chunk int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        chunk, n, total, out = 0, 0, 0, []
        for value in pdf[size]:
            out.append(chunk)
            n, total = n + 1, total + (value or 0)
            if n >= max_rows or total >= max_size:
                chunk, n, total = chunk + 1, 0, 0
        return pdf.assign(chunk=out)[[*names, "chunk"]]

    return rows.groupBy(*keys).applyInPandas(run, ddl)


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """rows with batch: consecutive runs of `size` rows per key."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(nth / size).cast("long"))


def previous_tail(scenes: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """scenes with prev_tail: the last line of the scene before, empty for the first."""
    last = F.element_at(F.split(F.lag(text).over(W.partitionBy(*keys).orderBy(*order)), "\n"), -1)
    return scenes.withColumn("prev_tail", F.coalesce(last, F.lit("")))


def rows_in_scenes(rows: DataFrame, scenes: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Range join: each row with the scene of its key whose start..end holds its position."""
    at = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in keys]
    inside = (F.col(f"r.{position}") >= F.col("s.start")) & (F.col(f"r.{position}") <= F.col("s.end"))
    for c in at:
        inside = inside & c
    return rows.alias("r").join(scenes.alias("s"), inside).select("r.*", "s.event_seq")


def raw_texts(rows: DataFrame, keys: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """The rows of each key joined by line breaks, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[text]), "\n").alias("raw_text"))
