import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import language_id, quality, sampling, toxicity

from .helpers import AWKWARD, LONG, table

LETTERS = {"aa": "ka lo mi ta ru", "bb": "sche ung ich eit er", "cc": "ção ñar óz él ú"}


def prose(rng, lang, n):
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, prose(rng, ("aa", "bb", "cc")[i % 3], rng.randint(3, 80)), ("aa", "bb", "cc")[i % 3]) for i in range(300)]


def labels_table(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def test_folds_are_those_of_crc32(spark):
    got = spark.range(200).select("id", sampling.fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == crc(r.id) % 5 for r in got)


def test_tables_equal_the_plain_network(corpus):
    net = language_id.train([(t.encode(), lang) for _, t, lang in corpus[:90]])
    raw = "Ünïcode and plain words 123 mixed in one text, ção ich".encode().lower()
    view, own = language_id._windows(raw * 9)
    got = language_id.Scorer(net).logits(view)
    for x, want in zip(view, got):
        pooled = []
        for i, k in enumerate(language_id.WIDTHS):
            z = [net.bias[i] + sum(net.tables[i][j][x[p + j]] for j in range(k)) for p in range(language_id.WINDOW - k + 1)]
            pooled.append(np.maximum(np.max(z, 0), 0))
        np.testing.assert_allclose(np.concatenate(pooled) @ net.weights + net.offset, want, rtol=1e-3, atol=1e-3)


def test_windows_cover_every_byte_and_gram():
    for n in (1, 5, language_id.WINDOW, language_id.WINDOW + 1, 1000, 5000):
        raw = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        view, own = language_id._windows(raw)
        grams = {raw[i : i + 4] for i in range(n - 3)}
        seen = {bytes(w[i : i + 4]) for w in view for i in range(language_id.WINDOW - 3)}
        assert grams <= seen and (own > 0).all()


def test_language_held_out_accuracy_and_awkward_rows(spark, corpus):
    rows = corpus + [(1000 + (i or 0), t, None) for i, t in AWKWARD] + [(2000, "123 !?", "aa"), (2001, "123", None)]
    docs = table(spark, rows)
    net = language_id.fit(docs)
    assert net.names == ["aa", "bb", "cc"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, net).collect()}
    held = [(i, lang) for i, _, lang in corpus if crc(i) % 3 == 1]
    assert len(held) > 60 and np.mean([got[i][0] == lang for i, lang in held]) > 0.95
    assert all(0 <= s <= 1 for _, s in got.values())
    assert got[1001] == got[1002] == got[1003] == got[2000] == got[2001] == ("und", 0.0)
    assert got[1006][0] in net.names


def test_language_learns_from_its_folds_only(spark, corpus):
    """Labels of held-out rows do not matter."""
    other = [(i, t, "zz" if crc(i) % 3 == 1 else lang) for i, t, lang in corpus]
    a, b = (language_id.fit(table(spark, rows)) for rows in (corpus, other))
    assert a.names == b.names and all((x == y).all() for x, y in zip(a.weights, b.weights))


def test_no_labels_and_empty_tables(spark):
    docs = table(spark, [(1, "some text"), (2, None)])
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs)).collect()} == {"und"}
    none = labels_table(spark, [])
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    empty = table(spark, [])
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert quality.score(empty, quality.fit(empty, none)).count() == 0
    assert toxicity.keep_clean(empty, toxicity.fit(empty, none)).count() == 0


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good, rude = i % 4 != 0, i % 5 == 0
        text = prose(rng, "aa", rng.randint(20, 60)) if good else " ".join(x.upper() + "!!" for x in prose(rng, "aa", 20).split())
        words = text.split()
        if rude:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobber", "plonkish", "vexlo" + rng.choice(["an", "er", "ix"])]))
        rows.append((i, " ".join(words)))
        if i % 10 != 9:
            labels.append((i, int(good), int(rude)))
    return rows, labels + [(None, 1, 1), (5000, 1, 0), (5001, None, None)] + labels[:5]


def test_quality_held_out(spark, judged):
    rows, labels = judged
    docs = table(spark, rows + [(9000 + (i or 0), t) for i, t in AWKWARD])
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels_table(spark, labels))).collect()}
    held = [(i, q) for i, q, _ in labels if i is not None and i < 400 and crc(i) % 5 == 0]
    assert len(held) > 40 and np.mean([(got[i] >= 0.5) == q for i, q in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_toxicity_held_out(spark, judged):
    rows, labels = judged
    docs = table(spark, rows + [(9000 + (i or 0), t) for i, t in AWKWARD])
    model = toxicity.fit(docs, labels_table(spark, labels))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(i, t) for i, _, t in labels if i is not None and i < 400 and crc(i) % 4 == 2]
    assert len(held) > 60 and np.mean([(got[i] >= 0.3) == t for i, t in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    left = toxicity.keep_clean(docs, model)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i in [r.doc_id for r in toxicity.score(docs, model).where("score < 0.3").collect()])


def test_features_of_words():
    lex = toxicity.Lexicon({"grobber": 3.0}, {"vexl": 2.0})
    at = dict(zip(toxicity.FEATURES, lex.features("You GROBBER! A vexlotan and an 1d10t, id!ot")))
    assert at["learned_density"] == pytest.approx(1 / 8) and at["begin_density"] == pytest.approx(1 / 8)
    assert at["near_log"] > 0 and at["undone_log"] > 0 and at["capital_share"] > 0
    assert not lex.features(None).any() and not lex.features(" ").any()
    assert lex.features(LONG).shape == (len(toxicity.FEATURES),)


def test_trees_and_isotonic_map():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = toxicity.grow(x, y, np.ones(600))
    assert (((toxicity.margins(forest, x) > 0) == y).mean()) > 0.97
    knots = toxicity.isotonic(np.array([3.0, 1, 2, 0]), np.array([1.0, 1, 0, 0]), np.ones(4))
    assert knots[0].tolist() == [0, 1.5, 3] and knots[1].tolist() == [0, 0.5, 1]


def test_packed_index_vectors_are_sparse_and_stable():
    a = quality.index_vectors(50)
    assert (a == quality.index_vectors(80)[:50]).all() and (np.abs(a).sum(1) <= quality.ONES).all() and len(np.unique(a, axis=0)) == 50
