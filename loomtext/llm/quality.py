"""Quality scores from random-indexing word vectors and a two-layer network.

Every symbol (a frequent word, or else the word's shape) has a fixed sparse ternary index
vector, made by rule from its number. A symbol's word vector is its own index vector plus
the normalised sum of the index vectors of its neighbours up to `REACH` words away. A text
is pooled in three channels: the mean vector of its words, of the shapes of all its words,
and of its repetitions (whether a word follows itself, or was met before in the text). A
two-layer network in numpy reads the standardised channels; its logit is divided by a
temperature that minimises the log loss on rows kept out of the fit.

Fitting uses at most `PER_CLASS` labelled rows of each class, the least by a hash of
doc_id, with whole texts; classes are weighted back to their counts over all labels. What
is gathered on the driver is bounded by parameters: the vocabulary (`VOCABULARY` words),
one co-occurrence sum for each of `PARTS` partitions, and one pooled vector a sampled row.

Scoring is a scan with Arrow batches and no shuffle over whole texts; the model, a few MB,
goes out in a broadcast.

Defined results: null is an empty text; a text without words is scored from zero vectors.
Without labels of both classes the score is the share of label 1, or 0.5. Where labels
repeat a doc_id, equal ones count once; documents that repeat one are learned from each. Rows, also repeated ones, each get their result.
Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .sampling import bounded_sample, fold, sampled_texts

PER_CLASS, VOCABULARY, MIN_DOCS = 2500, 12_000, 3
PARTS = 8
DIM, ONES, REACH = 40, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 40, 0.01, 1e-3
CACHE = 150_000
THRESHOLD = 0.3

_SHAPES = 512
_REPEATS = 8
_EDGE = re.compile(rb"[^\w\x80-\xff]*$")


def shape(word: bytes) -> int:
    """A small number for the look of a word: case, digits, length and closing marks."""
    tail = _EDGE.search(word)[0]
    body = word[: len(word) - len(tail)]
    letters = sum(c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in body)
    case = 0 if not letters else 1 if body.islower() else 2 if body.isupper() and letters > 1 else 3
    digits = 0 if not any(48 <= c <= 57 for c in body) else 1 if letters else 2
    size = min(3, len(body) // 5)
    inner = int(bool(re.search(rb"[^\w\x80-\xff'.-]", body)))
    mark = 0 if not tail else 1 if tail in (b",", b".") else 2 if tail in (b"!", b"?", b";", b":") else 3
    doubled = int(len(tail) > 1)
    return (((((case * 3 + digits) * 4 + size) * 2 + inner) * 4 + mark) * 2 + doubled) % _SHAPES


def index_vectors(count: int, dim: int = DIM, ones: int = ONES) -> np.ndarray:
    """Sparse ternary vectors, by rule from the number of the symbol."""
    out = np.zeros((count, dim), np.float32)
    state = np.arange(1, count + 1, dtype=np.uint64)
    for k in range(ones):
        state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k + 1)
        mixed = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        np.add.at(out, (np.arange(count), (mixed % np.uint64(dim)).astype(np.int64)), np.where(mixed >> np.uint64(63), 1, -1))
    return out


def key(word: bytes) -> bytes:
    """What a word is known by: itself, lower-cased, or a 128-bit hash where it is long."""
    word = word.lower()
    return word if len(word) <= 64 else b"\0" + xxhash.xxh128_digest(word)


class Symbols:
    """Symbol numbers of the words of a text: shapes first, then the vocabulary."""

    def __init__(self, vocabulary: list[bytes]):
        self.words = {w: _SHAPES + i for i, w in enumerate(vocabulary)}
        self.cache: dict[bytes, tuple[int, int]] = {}

    @property
    def count(self) -> int:
        return _SHAPES + len(self.words)

    def of(self, raw: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, shapes, repetitions), one number each per word."""
        words = (raw or b"").split()
        cache, known, got = self.cache, self.words, []
        if len(cache) > CACHE:
            cache.clear()
        seen: dict[bytes, int] = {}
        repeats, last = [], None
        for w in words:
            s = cache.get(w)
            if s is None:
                look = shape(w)
                s = (known.get(key(w), look), look)
                if len(w) <= 64:
                    cache[w] = s
            got.append(s)
            n = seen.get(w, 0)
            seen[w] = n + 1
            repeats.append((w == last) * 4 + (n if n < 3 else 3))
            last = w
        both = np.array(got, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1], np.array(repeats, np.int64)


@dataclass
class Model:
    prior: float
    vocabulary: list[bytes]
    vectors: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list | None = None
    temperature: float = 1.0


def pooled(symbols: Symbols, vectors: np.ndarray, raw: bytes | None) -> np.ndarray:
    words, shapes, repeats = symbols.of(raw)
    out = np.zeros(2 * DIM + _REPEATS, np.float32)
    n = len(words)
    if n:
        for at in range(0, n, 65536):
            out[:DIM] += vectors[words[at : at + 65536]].sum(0)
        out[DIM : 2 * DIM] = np.bincount(shapes, minlength=_SHAPES).astype(np.float32) @ vectors[:_SHAPES]
        out[2 * DIM :] = np.bincount(repeats, minlength=_REPEATS)
        out /= n
    return out


def _forward(layers: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.maximum(x @ w1 + b1, 0)
    return h, (h @ w2 + b2)[:, 0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, seed: int = 3) -> tuple[list, float]:
    """Layers, and the temperature from every fifth row, which the fit does not see."""
    rng = np.random.default_rng(seed)
    keep = np.arange(len(x)) % 5 != 4
    layers = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1),
    ]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    xt, yt, wt = x[keep], y[keep], weight[keep] / weight[keep].mean()
    for epoch in range(EPOCHS):
        order = rng.permutation(len(xt))
        for at in range(0, len(xt), 64):
            rows = order[at : at + 64]
            h, z = _forward(layers, xt[rows])
            d = ((_sigmoid(z) - yt[rows]) * wt[rows] / len(rows))[:, None]
            dh = (d @ layers[2].T) * (h > 0)
            grads = [xt[rows].T @ dh + DECAY * layers[0], dh.sum(0), h.T @ d + DECAY * layers[2], d.sum(0)]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for p, g, mp, vp in zip(layers, grads, m, v):
                mp += 0.1 * (g - mp)
                vp += 0.01 * (g * g - vp)
                p -= rate * (mp / (1 - 0.9**step)) / (np.sqrt(vp / (1 - 0.99**step)) + 1e-8)
    z, yv, wv = _forward(layers, x[~keep])[1], y[~keep], weight[~keep]
    best, temperature = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.5), np.log(8), 60)) if len(yv) >= 20 else ():
        p = np.clip(_sigmoid(z / t), 1e-9, 1 - 1e-9)
        loss = -(wv * (yv * np.log(p) + (1 - yv) * np.log(1 - p))).sum()
        if loss < best:
            best, temperature = loss, float(t)
    return layers, temperature


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return fold(doc_id, 5) != 0


def _cooccurrence(symbols: Symbols, texts: Iterator[bytes], index: np.ndarray) -> np.ndarray:
    out = np.zeros((symbols.count, DIM), np.float32)
    for raw in texts:
        words, _, _ = symbols.of(raw)
        for d in range(1, REACH + 1):
            a, b = words[:-d], words[d:]
            np.add.at(out, a, index[b])
            np.add.at(out, b, index[a])
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where(F.col("quality").isin(0, 1) & learnable(F.col("doc_id")))
    counts = {r["quality"]: r["n"] for r in known.select("doc_id", "quality").distinct().groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(prior, [])
    sample = bounded_sample(known, "quality", PER_CLASS, [0, 1])
    texts = sampled_texts(docs, sample).select("doc_id", F.col("text").cast("binary").alias("raw"), F.col("label").cast("int").alias("label"))
    texts = materialize(texts.repartition(PARTS, "doc_id"), "quality-sample")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("raw"):
                found = sorted({key(w) for w in (raw.as_py() or b"").split()})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["word"])

    frequent = texts.select("raw").mapInArrow(words_of, "word binary").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    vocabulary = [bytes(r["word"]) for r in frequent.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(vocabulary)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(held.value)
        out = _cooccurrence(symbols, (r.as_py() for b in batches for r in b.column("raw")), index_vectors(symbols.count))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    index = index_vectors(_SHAPES + len(vocabulary))
    sums = np.zeros_like(index)
    for row in texts.select("raw").coalesce(PARTS).mapInArrow(neighbours, "sums binary").toLocalIterator():
        sums += np.frombuffer(bytes(row["sums"]), np.float32).reshape(sums.shape)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = (index / np.sqrt(ONES) + sums / np.maximum(norm, 1e-6)).astype(np.float32)
    kept = sc.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(held.value)
        for batch in batches:
            rows = [pooled(symbols, kept.value, r.as_py()).tobytes() for r in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(pool, f"doc_id {kind}, label int, x binary").collect()
    rows.sort(key=lambda r: (hash_order(r["doc_id"]), r["label"], bytes(r["x"])))
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]) if rows else np.zeros((0, 2 * DIM + _REPEATS), np.float32)
    y = np.array([r["label"] for r in rows], np.float64)
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    if len(set(y.tolist())) < 2:
        return Model(prior, [])
    weight = np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0])
    mean, scale = x.mean(0), x.std(0) + 1e-4
    layers, temperature = train((x - mean) / scale, y, weight)
    return Model(prior, vocabulary, vectors, mean, scale, layers, temperature)


def hash_order(doc_id) -> int:
    import zlib

    return zlib.crc32(f"order{doc_id}".encode())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row; score is the calibrated probability of label 1."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        symbols = Symbols(m.vocabulary)
        for batch in batches:
            if m.layers is None:
                p = np.full(batch.num_rows, m.prior)
            else:
                x = np.stack([pooled(symbols, m.vectors, r.as_py()) for r in batch.column("_raw")]) if batch.num_rows else np.zeros((0, len(m.mean)))
                p = _sigmoid(_forward(m.layers, (x - m.mean) / m.scale)[1] / m.temperature)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.astype(np.float64))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("_raw")).mapInArrow(run, f"doc_id {kind}, score double")
