import random
import re

from pyspark.sql import functions as F

from loomtext.llm import decontaminate

from .helpers import AWKWARD, query, same_as_sql, table, write_tables


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(len(v), window)
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    ids.add(str(item_id))
        out.append((str(doc_id), len(w), len(hit), sorted(ids)))
    return sorted(out)


def run(spark, docs, items):
    rows = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("term", F.lit(1))
    got = decontaminate.scan(table(spark, docs).repartition(3), rows).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(str(x.item_id) for x in r["items"])) for r in got)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "É", "é", "rare1", "rare2", "x", "y", "42"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([13, 14, 20, 40]))) for i in range(25)]
    items += [(100, "short item text"), (101, "the"), (102, None), (103, " ., "), (104, "words that nobody ever wrote before now or later on at all ok"), (104, "Again 104 of another text")]
    docs = AWKWARD + [(None, items[0][1]), (1003, "same id, other text"), (1003, items[1][1])]
    for i in range(80):
        item = rng.choice(items[:26])[1]
        cut = item.split()[rng.randint(0, 4) : rng.choice([13, 17, 60])]
        docs.append((1000 + i, f"{some(rng.randint(0, 60))} {' '.join(cut).upper()}, {some(rng.randint(0, 40))}" + f" {item}" * rng.choice([0, 0, 1, 3])))
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert sum(1 for _, _, hit, _ in got if hit) > 20


def test_a_passage_in_most_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"w{i} {passage} tail{i % 3}") for i in range(300)] + [(999, "clean words only")]
    assert run(spark, docs, [(1, passage)]) == brute(docs, [(1, passage)])


def test_keep_clean_and_threshold(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    filler = " ".join(f"f{i}" for i in range(246))
    docs = table(spark, [(1, f"{passage} {filler}"), (2, f"{passage} {filler} x y"), (3, None), (None, "other"), (None, passage), (5, passage), (5, "clean, with the id of another"), (5, passage)])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    left = decontaminate.keep_clean(docs, items)
    assert left.columns == docs.columns
    # 13 of 259 words are over a twentieth; 13 of 261 are not
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "5", "None"]
    assert {r.text for r in left.collect()} >= {"other", "clean, with the id of another"}


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.scan(table(spark, []), items).count() == 0
    assert run(spark, [(1, "some words")], [(1, None)]) == [("1", 2, 0, [])]
    got = decontaminate.scan(table(spark, [(1, "some words")]), items.limit(0)).collect()
    assert [(r.doc_id, r.n_words, r.n_hit) for r in got] == [(1, 2, 0)]


def test_wide_vocabulary_takes_the_shuffle_join(spark):
    docs = table(spark, [(1, "a b c d"), (2, None)]).withColumnRenamed("doc_id", "row")
    words_ = spark.createDataFrame([("a",), ("c",)], "word string").withColumn("term", F.xxhash64("word"))
    index = decontaminate.build_index(docs, words_, max_broadcast=0)
    assert sorted((r.row, r.pos) for r in index.collect()) == [(1, 0), (1, 2), (1, 4), (2, 0)]


def test_proximity(spark):
    docs = table(spark, [(1, "red x x blue x red"), (2, "blue"), (3, "red " * 4 + "x " * 50 + "blue")]).withColumnRenamed("doc_id", "row")
    index = decontaminate.build_index(docs)
    for d in (1, 2, 3, 60):
        got = {(r.row, r.a, r.b) for r in decontaminate.proximity_match(index, "red", "blue", d).collect()}
        want = {
            (i, a, b)
            for i, t in [(1, "red x x blue x red"), (2, "blue"), (3, "red " * 4 + "x " * 50 + "blue")]
            for a, u in enumerate(t.split())
            for b, v in enumerate(t.split())
            if u == "red" and v == "blue" and abs(a - b) <= d
        }
        assert got == want


def near_brute(docs, items, window, slack, share):
    texts, out = [words(t) for _, t in docs], []
    counts = {}
    for w in texts:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    for (doc_id, _), w in zip(docs, texts):
        for item_id, item in items:
            v, shares = words(item), []
            n = min(len(v), window)
            for s in range(len(v) - n + 1 if v else 0):
                rare = sorted((counts[v[o]], o) for o in range(s, s + n) if v[o] in counts)[:2]
                if len(rare) < 2:
                    continue
                o, q = sorted(o for _, o in rare)
                # the lists stand for every place of each, counted by the first
                starts = {a - o + s for a, x in enumerate(w) if x == v[o] for b in range(a + 1, len(w)) if w[b] == v[q] and abs((a - o) - (b - q)) <= slack}
                for start in starts:
                    around = set(w[max(0, start - slack) : start + n + slack])
                    part = len(around & set(v[s : s + n])) / len(set(v[s : s + n]))
                    shares += [part] if part >= share else []
            if shares:
                out.append((str(doc_id), str(item_id), len(shares), max(shares)))
    return sorted(out)


def test_near_occurrences_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "é", "rare1", "rare2", "x", *(f"v{i}" for i in range(40))]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 2, 9, 13, 20])))) for i in range(12)]
    items += [(None, "no document has the words of the rare1 item"), (None, " "), (200, None), (201, "x x x x")]
    docs = AWKWARD + [(1003, "same id, other text"), (1003, items[3][1]), (1004, "x X x x, x")]
    for i in range(60):
        mid = rng.choice(items[:12])[1].split()
        for _ in range(rng.randint(0, 3)):  # words put in and changed, so that few exact windows survive
            at = rng.randint(0, len(mid))
            mid[at : at + rng.randint(0, 1)] = some(1)
        docs.append((2000 + i, " ".join(some(rng.randint(0, 30)) + mid + some(rng.randint(0, 30)))))
    rows = spark.createDataFrame(items, "item_id long, text string")
    for window, slack, share in [(13, 6, 0.8), (5, 2, 0.6)]:
        got = decontaminate.proximity(table(spark, docs).repartition(3), rows, window=window, slack=slack, share=share)
        have = sorted((str(r.doc_id), str(r.item_id), r.n_places, r.share) for r in got.collect())
        assert have == near_brute(docs, items, window, slack, share)
        assert len(have) > 30
        assert "Python" not in got._jdf.queryExecution().toString()
    assert decontaminate.proximity(table(spark, []), rows).count() == 0
    assert decontaminate.proximity(table(spark, docs), rows.limit(0)).count() == 0


def test_near_occurrence_where_no_window_survives(spark, tmp_path):
    passage = [f"p{i}" for i in range(26)]
    broken = " ".join(w + " put in" * (i % 9 == 8) for i, w in enumerate(passage))
    docs, items = [(1, f"a b {broken} c"), (2, "p3 p4 and p9 alone"), (3, " ".join(reversed(passage)))], [(7, " ".join(passage))]
    assert {(r[0], r[2]) for r in run(spark, docs, items)} == {("1", 0), ("2", 0), ("3", 0)}
    folder = write_tables(spark, tmp_path, docs, benchmark=(items, "item_id long, text string"))
    near = query(spark, folder, "benchmark_proximity").collect()
    assert [(r.doc_id, r.item_id, r.share) for r in near] == [(1, 7, 1.0)]


def test_sql_gives_the_same_rows_without_python_workers(spark, tmp_path):
    passage = " ".join(f"P{i}" for i in range(40))
    rows = [r for r in AWKWARD if r[0] not in (None, 6, 7, 13)] + [(20 + i, f"own words {i} " * i + passage[3 * i :]) for i in range(20)]
    items = [(i, passage[i * 9 :]) for i in range(9)] + [(9, "own WORDS 7"), (10, None)]
    got = same_as_sql(spark, tmp_path, "op8_decontaminate", rows, benchmark=(items, "item_id long, text string"))
    assert sum(r[-1] for r in got) > 5
    plan = query(spark, str(tmp_path), "op8_decontaminate")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
