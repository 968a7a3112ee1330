"""The pipeline against a brute-force version on a small corpus."""

import random

import pytest

import corpus_pipeline
from loomtext.llm import packing, toxicity

from .helpers import table
from .test_classifiers import labels_table
from .test_decontaminate import brute as brute_hits
from .test_exact_dedup import lowered
from .test_near_copies import brute as brute_near
from .test_packing import check


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    items = [(i, prose(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        text = prose(rng.randint(5, 120))
        if i % 6 == 0:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobber", "plonkish", "vexloid"]))
            text = " ".join(words)
        if i % 2 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, text))
    long = prose(700)
    rows += [(300 + i, rows[i][1].upper()) for i in range(1, 40, 2)]  # exact copies but for case
    rows += [(400 + i, long + f" {w}") for i, w in enumerate(vocabulary[:12])]  # near copies
    rows += [(500 + i, f"{prose(20)} {items[i][1]} {prose(20)}") for i in range(5)]  # contaminated
    rows += [(600, None), (601, ""), (602, " "), (603, "short")]
    folder = str(tmp_path_factory.mktemp("tables"))
    table(spark, rows).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels_table(spark, labels).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages_and_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    left = [(i, t) for i, t in rows if scores[i] < toxicity.THRESHOLD]
    assert 20 < len(rows) - len(left) < 60
    last = {}
    for i, t in left:
        last[lowered(t)] = max(i, last.get(lowered(t), -1))
    left = [(i, t) for i, t in left if last[lowered(t)] == i]
    stay = brute_near(left)
    left = [row for place, row in enumerate(left) if place in stay]
    hits = {int(i): (n, hit) for i, n, hit, _ in brute_hits(left, items)}
    left = [(i, t) for i, t in left if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])]
    assert not {i for i, _ in left} & set(range(500, 505)) and 1 < len({i for i, _ in left})
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, path).collect()]
    assert check(pieces, left, packing.Encoder(), packing.LIMIT) < 0.02


def test_each_stage_returns_the_columns_of_documents(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
