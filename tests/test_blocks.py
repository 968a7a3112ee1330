import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.functions import vectors as V
from loomtext.operators import retrieval


def test_blocks_of_queries_and_nodes_equal_one_block(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.selectExpr("id AS q", "v").where("q < 20")
    want = sorted(retrieval.nearest_each(vectors, queries, "id", "q", "v", 3).collect())
    assert len(want) == 60
    assert sorted(retrieval.nearest_each(vectors, queries, "id", "q", "v", 3, max_queries=7).collect()) == want
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(80)})
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "id string, ord long")
    asked = spark.createDataFrame([(x,) for x in names[::4]], "query string")
    want = sorted(retrieval.layered_search(asked, nodes, top=2).collect())
    assert want
    assert sorted(retrieval.layered_search(asked, nodes, top=2, max_nodes=8).collect()) == want


def test_column_names_and_upsert_after_a_broken_run(spark, tmp_path):
    import os

    from loomtext.sources import sinks

    assert [sinks.column_name(n) for n in (1, 26, 27, 52, 53, 702, 703, 18278, 18279)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ", "AAAA"]
    path = f"{tmp_path}/t"
    put = lambda *rows: sinks.upsert(spark, spark.createDataFrame(rows, "k int, v int, x string"), path, ["k"], "v")
    read = lambda: sorted((r.k, r.x) for r in spark.read.parquet(path).collect())
    put((1, 1, "a"), (2, 1, "b"))
    put((2, 2, "c"))
    assert read() == [(1, "a"), (2, "c")] and os.listdir(tmp_path) == ["t"]
    os.rename(path, f"{path}.aside")  # a run that ended before the new table was in place
    put((3, 3, "d"))
    assert read() == [(1, "a"), (2, "c"), (3, "d")] and os.listdir(tmp_path) == ["t"]


def test_nearest_each_equals_every_pair(spark):
    rng = random.Random(8)
    few = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(12)]  # many equal vectors and scores
    rows = [(i, few[i % 12] if i % 3 else [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300)]
    rows += [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [1.0, None, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    queries = vectors.selectExpr("id AS q", "v").where("q % 10 = 0 OR q > 899")
    pairs = vectors.crossJoin(queries.withColumnRenamed("v", "w")).select("q", "id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("id"))
    want = pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    plain = lambda df: sorted(map(repr, df.collect()))
    got = retrieval.nearest_each(vectors, queries, "id", "q", "v", 4)
    assert plain(got) == plain(want)
    alone = retrieval.nearest_each(vectors.where("id < 300"), queries.where("q < 300"), "id", "q", "v", 4)
    assert "NestedLoop" not in alone._jdf.queryExecution().toString()  # no row for every pair
