"""Toxicity with gradient-boosted trees over dense text features.

Features of a whole text: densities and counts of words from lexicons (a short list below,
and words and word beginnings learned from labelled texts), how many of them stand near a
second-person pronoun, shares of capitals, marks and stretched or obfuscated words, and
lexicon words that show only once an obfuscation is undone. Boosted depth-3 trees in numpy
read them; an isotonic map, fitted to out-of-fold scores, turns the margin into a
probability.

Fitting uses at most `POSITIVES` and `NEGATIVES` labelled rows, the least by a hash of
doc_id, with whole texts; classes are weighted back to their counts over all labels. The
sample is dealt into `FOLDS`: for the trees, a text's features come from a lexicon learned
without its fold, so that words count as they will in new texts; new texts meet the lexicon
of the whole sample. What is gathered on the driver is bounded: `LEXICON` words for each
fold and one short feature row for each sampled text.

Scoring is a scan with Arrow batches and no shuffle over whole texts; the model, well under
a MB, goes out in a broadcast.

Defined results: null is an empty text, with all features zero. Without labels of both
classes the score is the share of label 1, or 0. Rows, also repeated ones, each get their
result. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeps, materialize
from .sampling import bounded_sample, fold, sampled_texts

POSITIVES, NEGATIVES, LEXICON, FOLDS = 3000, 6000, 2000, 4
PREFIXES = (4, 5, 6)  # look() has them spelled out
MIN_DOCS, ODDS = 3, 8.0
NEAR = 4
TREES, DEPTH, BINS, RATE, LEAF = 60, 3, 32, 0.2, 4
CACHE = 200_000
THRESHOLD = 0.3

#: common insults, as a start for the learned lexicon
INSULTS = frozenset(
    "idiot idiots moron morons stupid scum loser losers trash worthless pathetic disgusting clown dumb fool jerk "
    "idiotisch dummkopf blödmann trottel abschaum arschloch imbécile idiote crétin connard salaud ordure abruti "
    "estúpido idiota imbécil basura asqueroso inútil patético tonto".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())

_STRIP = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_~|"
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})
_STRETCH = re.compile(r"(.)\1{2,}")
_MIXED = re.compile(r"[^\W\d_][0-9@$!*+._-]+[^\W\d_]")

FEATURES = (
    "learned_density", "learned_log", "begin_density", "begin_log", "listed_density", "listed_log", "distinct_log",
    "near_share", "near_log", "capital_share", "exclaim", "question", "marks", "odd_share", "undone_log", "stretched", "weight_log", "weight_density",
)


def key(word: str) -> str:
    """What a stripped, lower-cased word is known by: itself, or a 128-bit hash where it is long."""
    return word if len(word) <= 64 else "\0" + xxhash.xxh128_hexdigest(word)


@dataclass
class Lexicon:
    """Learned words and word beginnings with their log-odds."""

    words: dict[str, float] = field(default_factory=dict)
    begins: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.flagged: dict[str, tuple] = {}
        self.neutral: set[str] = set()

    def look(self, word: str) -> tuple | None:
        """Flags of a word: learned, begin, listed, undone, second person, capital, odd, stretched; weight.

        None for a word without any.
        """
        plain = word.strip(_STRIP).lower()
        learned = self.words.get(key(plain), 0.0)
        get = self.begins.get
        begin = max(get(plain[:4], 0.0), get(plain[:5], 0.0), get(plain[:6], 0.0)) if len(plain) >= 4 else 0.0
        listed, second = plain in INSULTS, plain in SECOND_PERSON
        capital = word.isupper() and sum(map(str.isalpha, word)) > 1
        stretched = len(plain) - len(set(plain)) > 1 and _STRETCH.search(plain) is not None
        odd, hidden, undone = False, False, plain
        if stretched or not plain.isalpha():
            odd = _MIXED.search(plain) is not None
            undone = re.sub(r"[^\w]|_", "", _STRETCH.sub(r"\1", plain.translate(_LEET)))
            hidden = undone != plain and (undone in self.words or undone in INSULTS)
        weight = max(learned, begin, self.words.get(undone, 2.0) if hidden else 0.0, 2.0 if listed else 0.0)
        if not (weight or second or capital or odd or stretched):
            return None
        return (learned > 0, begin > 0, listed, hidden, second, capital, odd, stretched, weight)

    def features(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        out = np.zeros(len(FEATURES))
        n = len(words)
        if not n:
            return out
        if len(self.neutral) + len(self.flagged) > CACHE:
            self.neutral.clear()
            self.flagged.clear()
        marked = {}  # most words have no flags, and are met as members of a set only
        for w in set(words) - self.neutral:
            flags = self.flagged.get(w)
            if flags is None:
                flags = self.look(w)
                if flags is None:
                    if len(w) <= 64:
                        self.neutral.add(w)
                    continue
                if len(w) <= 64:
                    self.flagged[w] = flags
            marked[w] = flags
        out[10:13] = text.count("!") / n, text.count("?") / n, sum(text.count(c) for c in "!?*$%&#") / n
        if not marked:
            return out
        places = np.array([i for i, w in enumerate(words) if w in marked])
        a = np.array([marked[words[i]] for i in places], np.float64)
        learned, begin, listed, hidden, second, capital, odd, stretched, weight = a.sum(0).tolist()
        hits = places[a[:, 8] > 0]
        near = 0
        if len(hits) and second:
            at = places[a[:, 4] > 0]
            left = at[np.clip(np.searchsorted(at, hits) - 1, 0, None)]
            right = at[np.clip(np.searchsorted(at, hits), None, len(at) - 1)]
            near = int((np.minimum(np.abs(hits - left), np.abs(right - hits)) <= NEAR).sum())
        out[:10] = (
            learned / n, np.log1p(learned), begin / n, np.log1p(begin), listed / n, np.log1p(listed),
            np.log1p(len({words[i].lower().strip(_STRIP) for i in hits})),
            near / max(1, len(hits)), np.log1p(near), capital / n,
        )
        out[13:] = odd / n, np.log1p(hidden), stretched / n, np.log1p(weight), weight / n
        return out


# --- trees ---------------------------------------------------------------------------


def _bin_edges(x: np.ndarray) -> list[np.ndarray]:
    edges = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) > BINS - 1:
            middle = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(middle)
    return edges


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list]:
    """Boosted trees for the log loss: (start, trees); a tree is nested (feature, cut, low, high) or a leaf."""
    edges = _bin_edges(x)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    trees = []

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(-RATE * gs / (hs + 1.0))
        if depth == DEPTH or len(rows) < 2 * LEAF:
            return leaf
        best, found = 1e-6, None
        for f in range(x.shape[1]):
            k = len(edges[f])
            if not k:
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], k + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], k + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=k + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -1
            j = int(gain.argmax())
            if gain[j] > best:
                best, found = gain[j], (f, j)
        if found is None:
            return leaf
        f, j = found
        low = binned[rows, f] <= j
        return (f, float(edges[f][j]), node(rows[low], g, h, depth + 1), node(rows[~low], g, h, depth + 1))

    weight = weight / weight.mean()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = node(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), 0)
        trees.append(tree)
        margin += _value(tree, x)
    return start, trees


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    below = x[:, f] <= cut
    out = np.empty(len(x))
    out[below], out[~below] = _value(low, x[below]), _value(high, x[~below])
    return out


def margins(forest: tuple[float, list], x: np.ndarray) -> np.ndarray:
    return forest[0] + sum((_value(t, x) for t in forest[1]), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing (margin, probability) knots."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of w*y, sum of w, sum of w*margin
    for i in order:
        blocks.append([weight[i] * y[i], weight[i], weight[i] * margin[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.array([m / w for _, w, m in blocks]), np.array([s / w for s, w, _ in blocks])


@dataclass
class Model:
    prior: float
    lexicon: Lexicon
    forest: tuple | None = None
    knots: tuple | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.forest is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(margins(self.forest, x), *self.knots), 0, 1)


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return fold(doc_id, 4) != 2


def _unit_counts(texts: DataFrame) -> DataFrame:
    """(unit, pos, neg): for words (w...) and beginnings (b...), arrays of document counts by fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, Counter] = {}
        for batch in batches:
            for text, label, part in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "part"))):
                words = {w.lower().strip(_STRIP) for w in (text or "").split()}
                units = {f"w{key(w)}" for w in words if len(w) > 1} | {f"b{w[:k]}" for w in words for k in PREFIXES if len(w) >= k}
                totals.setdefault((label, part), Counter()).update(units)
            if sum(map(len, totals.values())) > 500_000:
                yield from flush(totals)
        yield from flush(totals)

    def flush(totals: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (label, part), c in totals.items():
            n = len(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.string()), pa.array([label] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(list(c.values()), pa.int64())],
                names=["unit", "label", "part", "n"],
            )
        totals.clear()

    def by_fold(label: int) -> Column:
        return F.array(*[F.sum(F.when((F.col("label") == label) & (F.col("part") == k), F.col("n")).otherwise(0)) for k in range(FOLDS)])

    rows = texts.select("text", "label", "part").mapInArrow(count, "unit string, label int, part int, n long")
    return rows.groupBy("unit").agg(by_fold(1).alias("pos"), by_fold(0).alias("neg")).where(F.aggregate("pos", F.lit(0).cast("long"), lambda a, x: a + x) >= MIN_DOCS)


def _lexicon(counts: DataFrame, sizes: dict, without: int | None) -> Lexicon:
    """Words and beginnings that toxic texts have far more often than others, a fold left out."""
    folds = [k for k in range(FOLDS) if k != without]
    pos, neg = (sum((F.col(c)[k] for k in folds), F.lit(0)) for c in ("pos", "neg"))
    positives, negatives = (float(sum(sizes.get((label, k), 0) for k in folds)) for label in (1, 0))
    ratio = ((F.col("p") + 0.5) / F.lit(positives + 1)) / ((F.col("n") + 0.5) / F.lit(negatives + 1))
    best = (
        counts.select("unit", pos.alias("p"), neg.alias("n"))
        .withColumn("ratio", ratio)
        .where((F.col("p") >= MIN_DOCS) & (F.col("ratio") >= ODDS))
        .orderBy(F.desc(F.col("p") * F.log("ratio")), "unit")
        .limit(LEXICON)
        .collect()
    )
    lexicon = Lexicon()
    for r in best:
        (lexicon.words if r["unit"][0] == "w" else lexicon.begins)[r["unit"][1:]] = float(np.log(r["ratio"]))
    return lexicon


def _sample_features(texts: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """(doc_id, label, x): the feature row as bytes, from the lexicon without the row's fold."""
    held = texts.sparkSession.sparkContext.broadcast([(x.words, x.begins) for x in lexicons])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = [Lexicon(*x) for x in held.value]
        for batch in batches:
            rows = [local[k].features(t).tobytes() for t, k in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "label", "text", "part").mapInArrow(run, f"doc_id {kind}, label int, x binary")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.select("doc_id", "toxic").distinct().groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model(prior, Lexicon())
    sample = bounded_sample(known, "toxic", POSITIVES, [1]).union(bounded_sample(known, "toxic", NEGATIVES, [0]))
    texts = sampled_texts(docs, sample).withColumn("label", F.col("label").cast("int"))
    texts = texts.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(FOLDS)).cast("int"))
    texts = materialize(texts.repartition(8, "doc_id"), "toxic-sample")
    sizes = {(r["label"], r["part"]): r["n"] for r in texts.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    units = materialize(_unit_counts(texts), "toxic-units")
    lexicon = _lexicon(units, sizes, None)
    rows = _sample_features(texts, [_lexicon(units, sizes, k) for k in range(FOLDS)]).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["label"], bytes(r["x"])))
    x = np.array([np.frombuffer(bytes(r["x"])) for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(prior, lexicon)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    part = np.zeros(len(y), int)
    for c in (0.0, 1.0):  # folds with both classes in each
        part[y == c] = np.arange((y == c).sum()) % 3
    out = np.zeros(len(y))
    for k in range(3):
        rest = part != k
        if len(set(y[rest].tolist())) < 2:
            rest = np.ones(len(y), bool)
        out[part == k] = margins(grow(x[rest], y[rest], weight[rest]), x[part == k])
    return Model(prior, lexicon, grow(x, y, weight), isotonic(out, y, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row; score is the calibrated probability of label 1."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((model.prior, model.lexicon.words, model.lexicon.begins, model.forest, model.knots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("toxicity", dict)
        prior, words, begins, forest, knots = held.value
        local = Model(prior, Lexicon(words, begins), forest, knots)
        for batch in batches:
            x = np.array([local.lexicon.features(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(local.scores(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold; all columns stay, in one scan."""
    held = docs.sparkSession.sparkContext.broadcast((model.prior, model.lexicon.words, model.lexicon.begins, model.forest, model.knots))
    names = docs.columns
    place = names.index("text")
    ddl = ", ".join(f"c{i} {docs.schema[name].dataType.simpleString()}" for i, name in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("toxicity", dict)
        prior, words, begins, forest, knots = held.value
        local = Model(prior, Lexicon(words, begins), forest, knots)
        for batch in batches:
            x = np.array([local.lexicon.features(t.as_py()) for t in batch.column(place)]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(local.scores(x) < threshold))

    source = docs.select(*[F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(names)])
    return source.mapInArrow(run, ddl).toDF(*names)
