from pyspark.sql import functions as F

from loomtext.llm import common

from .helpers import AWKWARD, table


def test_words_and_lower_case(spark):
    df = spark.createDataFrame([("Ab-C é ÜX 1_2", ), (None,), ("--",), ("",)], "t string")
    got = [r.w for r in df.select(common.ascii_words(F.col("t")).alias("w")).collect()]
    assert got == [["ab", "c", "é", "Üx", "1", "2"], [], [], []]


def test_shifted_where_plans_are_interpreted(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"], []],)], "x array<array<string>>")
    assert df.select(F.transform("x", lambda w: common.shifted(w, 1)).alias("y")).first()["y"] == [["b"], [], []]


def test_tables_are_written_and_released(spark):
    df = common.materialize(table(spark, AWKWARD), "t")
    assert df.count() == len(AWKWARD)
    kept = spark.conf.get("spark.checkpoint.dir")
    common.release(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{kept}/loomtext-{spark.sparkContext.applicationId}")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert common.materialize(spark.range(3), "again").count() == 3


def test_batches_get_smaller_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    common.small_batches(spark, 700)
    common.small_batches(spark, 900)
    assert spark.conf.get(key) == "700"
    spark.conf.unset(key)


def test_a_worker_keeps_the_caches_of_one_operator(monkeypatch):
    gone = []
    monkeypatch.setattr(common, "_kept", {})
    common.keeps("a", lambda: gone.append("a"))
    common.keeps("a", lambda: gone.append("a"))
    assert gone == []
    common.keeps("b", lambda: gone.append("b"))
    assert gone == ["a"]
