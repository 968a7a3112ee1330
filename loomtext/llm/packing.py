"""Order-preserving packing of documents into training sequences.

Every document becomes its token ids and an end id. The ids of one input partition,
in their order, are cut into windows of at most `limit` ids; each window is a
sequence. A window is padded to `limit` unless its length is a power of two. The
cuts minimise padding plus penalties: a cut at a document's end is free, one at the
end of a sentence costs `SENTENCE` ids, one elsewhere `HARD` ids, and each sequence
`EACH`, so that a few large ones beat many small ones. Cuts elsewhere are considered
only where no sentence ends for a while.

With the padding of a window (i, j] being limit - (p_j - p_i), the least cost of a
prefix is min(best_i + p_i) + limit - p_j + penalty_j over all i within limit of j: a
sliding minimum that a monotone queue yields in constant time per cut. Lengths that
are powers of two are tried beside it. The last window of a partition is split into
powers of two where that is cheaper than padding it.

Nothing is shuffled: a partition is packed by the task that reads it, block by block
of about `BLOCK` ids with the last open window carried into the next block, so memory
is bounded by a block and the longest document. A lost task is redone on its own,
because no sequence crosses partitions.

Token ids come from a vocabulary file whose pre-tokeniser never joins characters
across white space, so ids are made once per distinct white-space-free piece and kept
in a bounded cache that the tasks of a Python worker share.

Defined results: null and empty texts are a document of the end id alone. Rows that
repeat a doc_id are documents of their own, in the order of the input. Other columns
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps

LIMIT = 4096
END_ID = 2
SENTENCE, HARD, EACH = 8, 48, 16
BLOCK = 1 << 20
GAP, STEP = 96, 48
CACHE = 400_000
VOCABULARY = "word_bpe_49k.json"
_LATIN = re.compile(r"[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,64}")
#: kinds of bytes: 1 a-z and digits, 2 ASCII marks, 3 ASCII white space, 0 others
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KIND[[*range(9, 14), 32]] = 3
#: the marks that join with a small letter of a-z and not with its capital: U+0308, U+030A, U+030C, U+0331 and, for U+0308, U+0344
_JOIN = re.compile(rb"\xcc[\x88\x8a\x8c\xb1]|\xcd\x84")
#: byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _joins(text: bytes) -> bool:
    return (b"\xcc" in text or b"\xcd" in text) and _JOIN.search(text) is not None


def _spaced(texts: list[bytes]) -> list[bytes]:
    """The texts with a space before each run of ASCII marks from a letter or digit to white space."""
    a = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # a byte that UTF-8 does not have
    kind = _KIND[a]
    edges = np.flatnonzero(np.diff(kind == 2, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    return np.insert(a, starts[(kind[starts - 1] == 1) & (kind[ends] == 3)], 32).tobytes().split(b"\xff")[:-1]


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        stops = [i for t, i in vocabulary.items() if t.endswith("</w>") and set(t[:-4]) & set(".!?") and not any(c.isalnum() for c in t[:-4])]
        stops += [e.ids[-1] for e in self.tokenizer.encode_batch(["。", "！", "？", "…"], add_special_tokens=False) if e.ids]
        self.stops, self.final = np.zeros(size, bool), np.zeros(size, bool)
        self.stops[stops] = True
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new pieces. Plain words take short cuts.

        A word of Latin letters is known to the merges as its bytes in the byte-level
        alphabet, lower-cased, so it goes to them alone. Another piece of letters is still
        one word to the tokeniser, and a word's last token is marked, so a row of words is
        encoded at once and falls apart at the marks. Where their number differs, the words
        are encoded one by one.
        """
        out: dict[bytes, bytes] = {}
        words, rest = [], []
        merge = self.tokenizer.model.tokenize
        for p in pieces:
            if p.isalpha() and p.islower() and len(p) <= 64:
                out[p] = array("I", [x.id for x in merge(p.decode())]).tobytes()
                continue
            t = p.decode("utf-8", "replace")
            if _LATIN.fullmatch(t):
                out[p] = array("I", [x.id for x in merge(t.lower().encode().decode("latin-1").translate(_BYTES))]).tobytes()
            else:
                (words if t.isalpha() else rest).append((p, t))
        for at in range(0, len(words), 4096):
            row = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in row])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(row):
                rest += row
                continue
            raw, begin = ids.tobytes(), 0
            for (p, _), end in zip(row, (4 * ends).tolist()):
                out[p] = raw[begin:end]
                begin = end
        if rest:
            out.update(zip([p for p, _ in rest], self._each([t for _, t in rest])))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # Case and a space before closing marks make no difference to the tokeniser, but make
        # fewer distinct pieces; texts that may hold special tokens are left alone, and so is
        # the case where a mark may follow that only a small letter joins with.
        special = {i: t for i, t in enumerate(texts) if b"<|" in t}
        texts = _spaced([b"" if i in special else t if _joins(t) else t.lower() for i, t in enumerate(texts)])
        split = [special.get(i, t).split() for i, t in enumerate(texts)]  # at ASCII white space only
        if len(self.cache) > CACHE:  # two generations: what is still in use is carried over
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        found, short, new = [], [], set()
        for pieces in split:
            ids = list(map(cache.get, pieces))
            try:
                found.append(b"".join(ids))
            except TypeError:  # some are not in the cache
                at = [i for i, x in enumerate(ids) if x is None]
                new.update([pieces[i] for i in at])
                short.append((len(found), pieces, ids, at))
                found.append(None)
        again = {p: ids for p in new if (ids := older.get(p)) is not None}
        cache.update(again)
        new = [p for p in new if p not in again]
        cache.update(self._ids(new))
        for n, pieces, ids, at in short:
            for i in at:
                ids[i] = cache[pieces[i]]
            found[n] = b"".join(ids)
        for p in new:
            if len(p) > 64:  # long pieces are seldom met again
                del cache[p]
        return found


@functools.cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder a process: its cache serves all tasks that the process runs."""
    return Encoder(path)


def plan(at: list[int], penalty: list[int], limit: int = LIMIT) -> list[int]:
    """The cheapest cuts, as indexes into `at` after the first, ending with the last.

    at: strictly increasing positions from 0 where a cut may be, at most limit apart.
    """
    place = np.array(at, np.int64)
    ends, starts = [], []  # pairs of cuts that are a smaller power of two apart
    for k in range(6, limit.bit_length() - 1):
        i = np.searchsorted(place, place - (1 << k))
        hit = np.flatnonzero(place[i] == place - (1 << k))
        ends.append(hit)
        starts.append(i[hit])
    ends, starts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, starts))
    order = np.argsort(ends, kind="stable")
    ends, starts = [*ends[order].tolist(), -1], starts[order].tolist()
    best, back, m = [0] * len(at), [0] * len(at), 0
    queue = deque([(0, 0)])  # (best_i + p_i, i), increasing
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - limit:
            queue.popleft()
        value, i = queue[0]
        cost = value + limit - p
        while ends[m] == j:
            k = starts[m]
            m += 1
            if best[k] < cost:
                cost, i = best[k], k
        cost += penalty[j] + EACH
        best[j], back[j] = cost, i
        value = cost + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def split_tail(start: int, end: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """The last window, in powers of two where padding costs more."""
    n = end - start
    if n & (n - 1) == 0 or limit - n <= (n.bit_count() - 1) * EACH:
        return [(start, end)]
    out = []
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            out.append((start, start + (1 << k)))
            start += 1 << k
    return out


class Packer:
    """Packs documents in order; feed add() and take pieces from flush()."""

    def __init__(self, stops: np.ndarray, limit: int = LIMIT, first_sequence: int = 0):
        self.stops, self.limit, self.sequence = stops, limit, first_sequence
        self.docs: list[tuple] = []  # doc_id, ids, ids of it that are gone, its length
        self.size = 0

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, ids, 0, len(ids) // 4))
        self.size += len(ids) // 4

    def _cuts(self) -> tuple[list[int], list[int]]:
        at, penalty, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, _, _ in self.docs:
            a = np.frombuffer(ids, "<u4")
            ends = np.flatnonzero(self.stops[a]) + 1
            ends = ends[ends < len(a) - 1]  # not between a last sentence and the end id
            marks = np.concatenate(([0], ends, [len(a)]))
            gaps = np.diff(marks)
            more = [np.arange(marks[k] + STEP, marks[k + 1], STEP) for k in np.flatnonzero(gaps > GAP)]
            if more:
                hard = np.concatenate(more)
                where = np.concatenate((ends, hard))
                cost = np.concatenate((np.full(len(ends), SENTENCE), np.full(len(hard), HARD)))
                order = np.argsort(where, kind="stable")
                where, cost = where[order], cost[order]
            else:
                where, cost = ends, np.full(len(ends), SENTENCE)
            at += [where + base, np.array([base + len(a)])]
            penalty += [cost, np.zeros(1, np.int64)]
            base += len(a)
        return np.concatenate(at).tolist(), np.concatenate(penalty).tolist()

    def flush(self, last: bool) -> list[tuple]:
        """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all closed windows."""
        if not self.size:
            return []
        at, penalty = self._cuts()
        ends = [at[i] for i in plan(at, penalty, self.limit)]
        windows = list(zip([0, *ends], ends))
        if last:
            windows[-1:] = split_tail(*windows[-1], self.limit)
        else:
            windows.pop()
        out, d, base = [], 0, 0  # document number d starts at base
        for start, end in windows:
            here = start
            while here < end:
                doc_id, ids, gone, total = self.docs[d]
                n = len(ids) // 4
                stop = min(end, base + n)
                out.append((doc_id, gone + here - base, stop - here, ids[4 * (here - base) : 4 * (stop - base)], total, self.sequence, here - start))
                here = stop
                if here == base + n:
                    d, base = d + 1, base + n
            self.sequence += 1
        done = windows[-1][1] if windows else 0
        rest = self.docs[d:]
        if rest and done > base:
            doc_id, ids, gone, total = rest[0]
            rest[0] = (doc_id, ids[4 * (done - base) :], gone + done - base, total)
        self.docs, self.size = rest, self.size - done
        return out


def pack(docs: DataFrame, *, tokenizer_path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids is the piece as little-endian unsigned 32-bit integers; start counts its
    document's ids before it, and offset the ids before it in its sequence. limit is
    a power of two.
    """
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema(
        [
            ("doc_id", to_arrow_type(kind)),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keeps("packing", encoder.cache_clear)
        own = encoder(tokenizer_path)
        packer = Packer(own.stops, limit, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = own.encode([x or b"" for x in part.column("_raw").to_pylist()])
                for doc_id, got in zip(part.column("doc_id").to_pylist(), ids):
                    packer.add(doc_id, got + end)
                    if packer.size >= block and (out := packer.flush(False)):
                        yield rows(out)
        if out := packer.flush(True):
            yield rows(out)

    ddl = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", F.col("text").cast("binary").alias("_raw")).mapInArrow(run, ddl)
