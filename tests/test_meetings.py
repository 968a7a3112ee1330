"""Meetings by blocks of names against the join."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.operators import graphs, meetings


def tables(spark, kind):
    rng = random.Random(4)
    rows = [(rng.randrange(12 if i % 4 else 300), f"u{rng.randrange(70)}") for i in range(900)] + [(1, None), (None, "u1")]
    acts = spark.createDataFrame(rows, "scene long, who string").selectExpr(f"cast(scene AS {kind}) AS scene", "who")
    more = spark.createDataFrame([(3, "silent"), (4, "silent")], "scene long, name string").selectExpr(f"cast(scene AS {kind}) AS scene", "name")
    return acts, acts.select("scene", F.col("who").alias("name")).union(more).where("name <> 'u7'").distinct()


def plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind,dense", [("long", 100), ("string", 100), ("long", 0)])
def test_blocks_equal_the_join(spark, monkeypatch, kind, dense):
    monkeypatch.setattr(meetings, "DENSE", dense)
    monkeypatch.setattr(meetings, "ROWS", 8)
    monkeypatch.setattr(meetings, "EXPANDED", 40)
    monkeypatch.setattr(meetings, "blocks_for", lambda rows, joined: 0 if joined else 3)
    acts, cast = tables(spark, kind)
    acts = acts.where("who IS NOT NULL")
    want = plain(graphs.cooccurrence(cast, "scene", "name", least=3))
    assert len(want) > 100
    assert plain(graphs.cooccurrence(cast, "scene", "name", least=3, joined=0)) == want
    degree = plain(graphs.degrees(graphs.cooccurrence(cast, "scene", "name", least=3)))
    assert plain(graphs.cooccurrence_degrees(cast, "scene", "name", least=3, joined=0)) == degree
    met = graphs.directed_cooccurrence(acts, cast, "scene", "who", "name")
    assert plain(graphs.directed_cooccurrence(acts, cast, "scene", "who", "name", joined=0)) == plain(met)
    order = Window.partitionBy("actor").orderBy(F.desc("acts"), "other")
    top = lambda df: plain(df.withColumn("k", F.row_number().over(order)).where("k <= 4"))
    some = graphs.directed_cooccurrence(acts, cast, "scene", "who", "name", joined=0, best=4)
    assert top(some) == top(met) and some.count() < met.count()
    nodes = graphs.nodes(acts.select(F.col("who").alias("name"), F.length("who").alias("chapter")))
    edges = graphs.cooccurrence(cast, "scene", "name", least=3)
    kept, inner = graphs.truncated(graphs.weighted_nodes(nodes, edges), edges, 12)
    got = graphs.truncated_cooccurrence(nodes, cast, "scene", "name", least=3, top=12, joined=0)
    assert plain(got[1]) == plain(inner) and plain(got[0]) == plain(kept)


def test_many_pairs_of_few_rows_are_not_joined(spark):
    rows = spark.range(40).selectExpr("id % 2 AS scene", "concat('n', id) AS name")
    held = rows.selectExpr("scene AS s", "name AS n", "0L AS acts", "1 AS there")
    assert meetings.blocks_for(held, joined=100_000) == 0 and meetings.blocks_for(held, joined=100) == 1
    out = graphs.cooccurrence(rows, "scene", "name", least=1, joined=100)
    assert out.count() == 2 * 190 and "MapInArrow" in out._jdf.queryExecution().toString()
