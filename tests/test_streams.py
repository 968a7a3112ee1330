"""Streams write their results where executors share them."""


def test_stream_results_are_not_gathered_in_the_driver(spark, tmp_path):
    from loomtext.streaming import sessions

    rows = [(u, f"2024-01-01 {h:02}:00:00") for u in range(20) for h in (1, 2, 9)]
    events = spark.createDataFrame(rows, "user_id long, t string").selectExpr("user_id", "cast(t AS timestamp) AS ts")
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    got = sessions.replay(spark, f"{tmp_path}/events.parquet", "90 minutes")
    assert sorted((r.user_id, r.events) for r in got.collect()) == sorted([(u, 2) for u in range(20)] + [(u, 1) for u in range(20)])
    assert "Relation" in got._jdf.queryExecution().optimizedPlan().toString() and got.inputFiles()
