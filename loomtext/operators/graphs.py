"""Graphs: co-occurrence, relations, nodes with weights, truncation, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import meetings
from .components import _checkpointed


def _together(members: DataFrame, scene: str, name: str) -> DataFrame:
    rows = members.select(F.col(scene).alias("s"), F.col(name).alias("n")).where("s IS NOT NULL AND n IS NOT NULL").distinct()
    return rows.select("s", "n", F.lit(0).cast("long").alias("acts"), F.lit(1).alias("there"))


def cooccurrence(members: DataFrame, scene: str, name: str, *, least: int = 2, without: DataFrame | None = None, max_group: int | None = None, joined: int = meetings.JOINED) -> DataFrame:
    """(a, b, weight), a < b: pairs of names and the number of scenes that hold both.

    A join has a row for each pair and scene; if those are many over `joined`, blocks of names
    count their pairs instead. A scene's names are few by nature in a book; max_group, if given, guards that by raising
    instead of dropping. without: pairs (a, b) that have an explicit relation.
    """
    rows = members.select(F.col(scene).alias("_s"), F.col(name).alias("_n")).where("_n IS NOT NULL").distinct()
    if max_group is not None:
        worst = rows.groupBy("_s").count().agg(F.max("count")).first()[0] or 0
        if worst > max_group:
            raise ValueError(f"a scene has {worst} names, over the limit of {max_group}")
    held = _together(rows, "_s", "_n")
    blocks = meetings.blocks_for(held, joined)
    if blocks:
        out = meetings.pairs(held, blocks, least)
    else:
        pairs = rows.alias("x").join(rows.alias("y"), (F.col("x._s") == F.col("y._s")) & (F.col("x._n") < F.col("y._n")))
        out = pairs.groupBy(F.col("x._n").alias("a"), F.col("y._n").alias("b")).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    if without is None:
        return out
    bad = without.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return out.join(bad, ["a", "b"], "left_anti")


def cooccurrence_degrees(members: DataFrame, scene: str, name: str, *, least: int = 2, joined: int = meetings.JOINED) -> DataFrame:
    """(name, degree): the edges of cooccurrence() at each name, which are only made if they are few."""
    held = _together(members, scene, name)
    blocks = meetings.blocks_for(held, joined)
    return meetings.partners(held, blocks, least) if blocks else degrees(cooccurrence(members, scene, name, least=least))


def directed_cooccurrence(acts: DataFrame, members: DataFrame, scene: str, actor: str, name: str, *, best: int | None = None, joined: int = meetings.JOINED) -> DataFrame:
    """(actor, other, acts): for each act, its actor meets every other name of the scene.

    Acts are counted per scene and actor before the join, so the join has one row per
    pair of names and scene, not per act; if those are many over `joined`, blocks of names
    count their meetings instead. best: only the first so many others of each actor are
    needed, by acts and name; there may be more.
    """
    did = acts.groupBy(F.col(scene).alias("_s"), F.col(actor).alias("actor")).agg(F.count("*").alias("_n"))
    there = members.select(F.col(scene).alias("_s"), F.col(name).alias("other")).distinct()
    held = meetings.together(did.select(F.col("_s").alias("s"), F.col("actor").alias("n"), F.col("_n").alias("acts")), there.select(F.col("_s").alias("s"), F.col("other").alias("n")))
    blocks = meetings.blocks_for(held, joined)
    if blocks:
        return meetings.directed(held, blocks, best)
    met = did.join(there, "_s").where("actor <> other")
    return met.groupBy("actor", "other").agg(F.sum("_n").alias("acts"))


def explicit_edges(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, label) of (name, target, label): targets resolved to names, self loops dropped.

    names: (name, canonical). Exact names first, else the first name by order that
    contains the target or lies in it.
    """
    from .entities import first_containing

    exact = relations.join(names.select(F.col("name").alias("target"), F.col("canonical").alias("b")), "target", "left")
    rest = exact.where("b IS NULL").select("name", "target", "label")
    order = names.select("name", F.col("name").alias("ord"))
    owners = first_containing(rest.select(F.col("target").alias("_k"), "target").distinct(), order, "_k", "target").select("target", "owner")
    found = rest.join(owners, "target").join(names.select(F.col("name").alias("owner"), F.col("canonical").alias("b")), "owner").select("name", "b", "label")
    return exact.where("b IS NOT NULL").select("name", "b", "label").unionByName(found).select(F.col("name").alias("a"), "b", "label").where("a <> b")


def setting_edges(relations: DataFrame, settings: DataFrame, people: DataFrame) -> DataFrame:
    """(a, b, how, kind): relations of settings, to a setting or else a character; one an unordered pair.

    relations: (name, to, how, ord); settings and people: (name).
    """
    to = relations.join(settings.select(F.col("name").alias("to"), F.lit(True).alias("_s")).distinct(), "to", "left")
    to = to.join(people.select(F.col("name").alias("to"), F.lit(True).alias("_p")).distinct(), "to", "left").where("(_s OR _p) AND name <> to")
    order = W.partitionBy(F.least("name", "to"), F.greatest("name", "to")).orderBy("ord")
    one = to.withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return one.select(F.col("name").alias("a"), F.col("to").alias("b"), "how", F.when(F.col("_s"), "setting").otherwise("character").alias("kind"))


def nodes(*appearances: DataFrame) -> DataFrame:
    """(name, chapters, first_seen) of tables (name, chapter): scenes, events, first mentions."""
    rows = appearances[0].select("name", "chapter")
    for a in appearances[1:]:
        rows = rows.union(a.select("name", "chapter"))
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("chapter")).alias("chapters"), F.min("chapter").alias("first_seen"))


def degrees(edges: DataFrame) -> DataFrame:
    """(name, degree): the edges at each end."""
    return edges.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def weighted_nodes(node_table: DataFrame, edges: DataFrame | None = None, degree: DataFrame | None = None) -> DataFrame:
    """Nodes with degree and weight, chapters plus degree; the degrees of edges, or (name, degree)."""
    out = node_table.join(degrees(edges) if degree is None else degree, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return out.withColumn("weight", (F.size("chapters") + F.col("degree")).cast("long"))


def truncated(node_table: DataFrame, edges: DataFrame, top: int = 600, always: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The top nodes by weight, and those that always stay; edges with both ends kept."""
    ranked = node_table if always is None else node_table.where(~always)
    kept = ranked.orderBy(F.desc("weight"), "name").limit(top)
    if always is not None:
        kept = kept.unionByName(node_table.where(always))
    ends = kept.select("name")
    left = edges.join(ends.withColumnRenamed("name", "a"), "a", "left_semi").join(ends.withColumnRenamed("name", "b"), "b", "left_semi")
    return kept, left.select(*edges.columns)


def truncated_cooccurrence(node_table: DataFrame, members: DataFrame, scene: str, name: str, *, least: int = 2, top: int = 600, joined: int = meetings.JOINED) -> tuple[DataFrame, DataFrame]:
    """truncated() over the edges of cooccurrence(), of which only those between kept nodes are made."""
    weighted = weighted_nodes(node_table, degree=cooccurrence_degrees(members, scene, name, least=least, joined=joined))
    kept = _checkpointed(weighted.orderBy(F.desc("weight"), "name").limit(top))
    inner = members.join(kept.select(F.col("name").alias(name)), name, "left_semi")
    return kept, cooccurrence(inner, scene, name, least=least, joined=joined)


def timeline(events: DataFrame, chapter: str, text: str, order: str) -> DataFrame:
    """(chapter, events): texts of a chapter in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return events.groupBy(chapter).agg(F.transform(rows, lambda x: x[text]).alias("events"))


def first_occurrences(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The first row of each name: what is new in its chapter."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(name).orderBy(*order))).where("_k = 1").drop("_k")


def wide_clusters(evidence: DataFrame, cluster: str, chapter: str, span: int = 5, weight: str | None = None) -> DataFrame:
    """Clusters whose evidence spans at least `span` chapters, heaviest first."""
    total = F.sum(weight) if weight else F.count("*")
    out = evidence.groupBy(cluster).agg(F.min(chapter).alias("first"), F.max(chapter).alias("last"), total.alias("weight"))
    return out.where(F.col("last") - F.col("first") >= span).orderBy(F.desc("weight"), cluster)


def hubs(rows: DataFrame, name: str, listed: str, top: int = 10) -> DataFrame:
    """The rows with the longest lists."""
    return rows.select(name, F.size(listed).cast("long").alias("n")).orderBy(F.desc("n"), name).limit(top)


def merge_settings(rows: DataFrame, alias_map: DataFrame, people: DataFrame) -> DataFrame:
    """Settings by canonical name: related united, the longest description, the last type.

    rows: (name, type, description, related, ord); alias_map: (name, canonical). Names of
    characters are left out.
    """
    named = rows.join(alias_map, "name", "left").withColumn("name", F.coalesce("canonical", "name")).join(people.select("name"), "name", "left_anti")
    longest = F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("ord"))
    return named.groupBy("name").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("related")))).alias("related"),
        F.max_by("description", longest).alias("description"),
        F.max_by("type", F.when(F.col("type") != "", F.col("ord"))).alias("type"),
    )


def well_related(settings: DataFrame, least: int = 5) -> DataFrame:
    return settings.where(F.size("related") >= least)


def category_buckets(settings: DataFrame, category: str, name: str, top: int = 20) -> DataFrame:
    """(category, names): up to `top` names of a category, in order."""
    return settings.groupBy(category).agg(F.slice(F.array_sort(F.collect_set(name)), 1, top).alias("names"), F.count("*").alias("n"))


def mapped(rows: DataFrame, column: str, mapping: DataFrame, other: str = "其他") -> DataFrame:
    """rows with the column's values replaced by a table (from, to); unknown ones become `other`."""
    known = F.broadcast(mapping.select(F.col("from").alias("_f"), F.col("to").alias("_t")))
    return rows.join(known, F.col(column) == F.col("_f"), "left").withColumn(column, F.coalesce("_t", F.lit(other))).drop("_f", "_t")
