"""Language identification with a byte convolutional network.

The network reads fixed-length windows of `WINDOW` bytes: embeddings of the bytes, filters
of widths 2, 3 and 4 with ReLU, max pooling over the window, and a softmax layer. It is
trained in numpy, with Adam, on windows drawn over the whole length of a bounded sample of
labelled texts.

A filter over one-hot bytes is a sum of table lookups, so a trained filter bank is folded
into tables for pairs of bytes and applied to whole batches of windows at once. A text is
cut into windows over its whole length, each overlapping the next by the widest filter less
one, so that every n-gram of the text is seen; its class probabilities are the softmax of
the mean window logits, weighted by the bytes of a window.

Prediction is a scan with Arrow batches and no shuffle; the network, about 100 KB, goes out
in a broadcast. Windows are processed in blocks of bounded size, however long a text is.

Defined results: a text that is null or has no letter is `und` with score 0. Without any
labelled row every text is `und`. Rows, also repeated ones, each get their result. Other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample, fold, sampled_texts

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
STEP = WINDOW - max(WIDTHS) + 1
#: the bounds of the training sample: documents per language, windows per document
PER_LANGUAGE, WINDOWS = 400, 6
EPOCHS, BATCH, RATE = 4, 48, 0.01
BLOCK = 2048  # windows at a time
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Network:
    names: list[str]
    tables: list[list[np.ndarray]]  # per width, per offset: 256 x FILTERS
    bias: np.ndarray  # widths x FILTERS
    weights: np.ndarray  # (widths * FILTERS) x classes
    offset: np.ndarray  # classes


def _windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, zero-padded, and the bytes of each that are its own."""
    data = np.frombuffer(raw, np.uint8)
    n = max(1, -(-(len(data) - WINDOW + STEP) // STEP)) if len(data) > WINDOW else 1
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(data)] = data
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
    own = np.minimum(WINDOW, len(data) - STEP * np.arange(n))
    return view, own


def _drawn(raw: bytes, count: int, rng: np.random.Generator) -> np.ndarray:
    view, own = _windows(raw)
    full = np.flatnonzero(own >= min(48, own.max()))
    return view[np.sort(rng.permutation(full)[:count])]


def train(texts: list[tuple[bytes, str]], *, seed: int = 7) -> Network | None:
    """Fit the network; texts: (UTF-8 text, language)."""
    names = sorted({lang for _, lang in texts})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for raw, lang in texts:
        if raw.strip():
            w = _drawn(raw.lower(), WINDOWS, rng)
            xs.append(w)
            ys += [names.index(lang)] * len(w)
    x, y = np.concatenate(xs) if xs else np.zeros((0, WINDOW), np.uint8), np.array(ys, np.int64)
    tables = [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(k)] for k in WIDTHS]
    bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
    weights = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32)
    offset = np.zeros(len(names), np.float32)
    params = [t for ts in tables for t in ts] + [bias, weights, offset]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            xb, yb = x[rows], y[rows]
            b, pooled, where = len(xb), [], []
            for i, k in enumerate(WIDTHS):
                n = WINDOW - k + 1
                z = bias[i] + sum(tables[i][j][xb[:, j : j + n]] for j in range(k))
                top = z.argmax(1)
                where.append(top)
                pooled.append(np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0], 0))
            h = np.concatenate(pooled, 1)
            logits = h @ weights + offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(b), yb] -= 1
            p /= b
            dh = (p @ weights.T) * (h > 0)
            grads: list[np.ndarray] = []
            d_bias = np.zeros_like(bias)
            for i, k in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                d_bias[i] = d.sum(0)
                for j in range(k):
                    g = np.zeros_like(tables[i][j])
                    np.add.at(g, (xb[np.arange(b)[:, None], where[i] + j], np.arange(FILTERS)[None, :]), d)
                    grads.append(g)
            grads += [d_bias, h.T @ p, p.sum(0)]
            step += 1
            for q, g, mq, vq in zip(params, grads, m, v):
                mq += 0.1 * (g - mq)
                vq += 0.01 * (g * g - vq)
                q -= rate * (mq / (1 - 0.9**step)) / (np.sqrt(vq / (1 - 0.99**step)) + 1e-7)
    return Network(names, tables, bias, weights, offset)


class Scorer:
    """The network with its filters folded into tables over pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        two, three, four = net.tables

        def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)

        # one lookup of a pair serves the filters of width 2, and the first bytes of 3 and 4
        self.front = np.ascontiguousarray(
            np.concatenate([pairs(two[0], two[1]), pairs(three[0], three[1]), pairs(four[0], four[1])], 1), dtype=np.float32
        )
        self.third = three[2]
        self.back = np.ascontiguousarray(pairs(four[2], four[3]), dtype=np.float32)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        out = []
        f = FILTERS
        for at in range(0, len(windows), 64):  # a slice that stays in cache
            x = windows[at : at + 64]
            pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            z = self.front[pair]
            two = z[:, :, :f].max(1)
            three = (z[:, :-1, f : 2 * f] + self.third[x[:, 2:]]).max(1)
            four = (z[:, :-2, 2 * f :] + self.back[pair[:, 2:]]).max(1)
            h = np.maximum(np.concatenate([two, three, four], 1) + self.net.bias.reshape(-1), 0)
            out.append(h @ self.net.weights + self.net.offset)
        return np.concatenate(out)

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        out: list = [None] * len(texts)
        views, weights, owner, held = [], [], [], 0
        sums = np.zeros((len(texts), len(self.net.names)))
        total = np.zeros(len(texts))

        def close() -> None:
            if views:
                got = self.logits(np.concatenate(views))
                w, o = np.concatenate(weights), np.concatenate(owner)
                np.add.at(sums, o, got * w[:, None])
                np.add.at(total, o, w)
                views.clear(), weights.clear(), owner.clear()

        for i, raw in enumerate(texts):
            if not has_letter(raw):
                out[i] = ("und", 0.0)
                continue
            view, own = _windows(raw.lower())
            for at in range(0, len(view), BLOCK):
                part = view[at : at + BLOCK]
                views.append(part)
                weights.append(own[at : at + BLOCK].astype(np.float64))
                owner.append(np.full(len(part), i))
                held += len(part)
                if held >= BLOCK:
                    close()
                    held = 0
        close()
        rows = [i for i in range(len(texts)) if out[i] is None]
        if rows:
            mean = sums[rows] / total[rows][:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i, k, row in zip(rows, best, p):
                out[i] = (self.net.names[k], float(row[k]))
        return out


def has_letter(raw: bytes | None) -> bool:
    if not raw:
        return False
    if _ASCII_LETTER.search(raw):
        return True
    return not raw.isascii() and any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from; the others are held out."""
    return fold(doc_id, 3) != 1


def fit(docs: DataFrame) -> Network | None:
    """Train on a bounded sample: the least PER_LANGUAGE ids by hash of each language."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
    sample = bounded_sample(known.withColumnRenamed("lang", "label"), "label", PER_LANGUAGE)
    rows = sampled_texts(docs, sample).select(F.col("text").cast("binary").alias("raw"), "label")
    spread = _spread_windows(rows).collect()  # windows only: bounded by the sample's parameters
    return train([(bytes(r["raw"]), r["label"]) for r in spread])


def _spread_windows(rows: DataFrame) -> DataFrame:
    """Stretches of whole windows, spread evenly over each text, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, labels = [], []
            for raw, label in zip(batch.column("raw").to_pylist(), batch.column("label").to_pylist()):
                if has_letter(raw):
                    n = len(raw)
                    starts = sorted({max(0, (n - WINDOW) * i // max(1, WINDOWS - 1)) for i in range(WINDOWS)})
                    raws += [raw[s : s + WINDOW] for s in starts]
                    labels += [label] * len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(raws, pa.binary()), pa.array(labels, pa.string())], names=["raw", "label"])

    return rows.mapInArrow(run, "raw binary, label string")


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value is not None else None
        for batch in batches:
            langs, scores = [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.column("_raw").slice(at, 256).to_pylist()
                for lang, score in scorer.predict(part) if scorer else [("und", 0.0)] * len(part):
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("_raw")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
