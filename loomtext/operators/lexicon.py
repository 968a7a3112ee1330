"""The lexicon as a graph: edges, lookups, neighbours, gaps, genres, generic terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lexicon_nodes(slots: DataFrame) -> DataFrame:
    """(id, domain, slot, rank, ord): a word belongs to the first domain that lists it.

    slots: (domain, slot, items, ordered, ord). rank is the place in an ordered slot.
    """
    rows = slots.select("domain", "slot", "ordered", "ord", F.posexplode("items").alias("pos", "id"))
    first = W.partitionBy("id").orderBy("ord", "pos")
    one = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return one.select("id", "domain", "slot", F.when(F.col("ordered"), F.col("pos") + 1).cast("long").alias("rank"), (F.col("ord") * 100_000 + F.col("pos")).cast("long").alias("ord"))


def lexicon_edges(nodes: DataFrame) -> DataFrame:
    """(a, b, type): in_domain to the domain's centre, next_level between neighbouring ranks,
    aligned_with between equal ranks of the ordered slots of a domain."""
    in_domain = nodes.select(F.col("id").alias("a"), F.concat(F.lit("domain:"), F.col("domain")).alias("b"), F.lit("in_domain").alias("type"))
    after = F.lead("id").over(W.partitionBy("domain", "slot").orderBy("rank"))
    steps = nodes.where("rank IS NOT NULL").withColumn("b", after).where("b IS NOT NULL").select(F.col("id").alias("a"), "b", F.lit("next_level").alias("type"))
    ranked = nodes.where("rank IS NOT NULL").select("id", "domain", "slot", "rank")
    same = ranked.alias("x").join(ranked.alias("y"), ["domain", "rank"]).where("x.slot < y.slot")
    aligned = same.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit("aligned_with").alias("type"))
    return in_domain.unionByName(steps).unionByName(aligned)


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, start: DataFrame, hops: int = 1, types: Sequence[str] | None = None) -> DataFrame:
    """(start, id, hop, via): what a breadth-first walk finds, never through domain centres.

    start: (id). edges are walked both ways; via is the type of the edge that found a node.
    """
    used = edges if types is None else edges.where(F.col("type").isin(*types))
    both = used.select("a", "b", "type").union(used.select("b", "a", "type")).select(F.col("a").alias("_from"), F.col("b").alias("_to"), "type")
    seen = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"))
    front = seen
    for hop in range(1, hops + 1):
        from_ = front.where(~F.col("id").startswith("domain:")) if hop > 1 else front
        step = from_.join(both, F.col("id") == F.col("_from")).groupBy("start", F.col("_to").alias("id")).agg(F.min("type").alias("via"))
        front = step.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(hop).alias("hop"), "via")
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def gaps(nodes: DataFrame, used: DataFrame, *, least: int = 2, top: int = 20) -> DataFrame:
    """(domain, slot, id, rank): items between the first and last used rank that are not used."""
    hits = nodes.join(used.select("id").distinct(), "id", "left_semi").where("rank IS NOT NULL")
    span = hits.groupBy("domain", "slot").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least)
    inside = nodes.join(span, ["domain", "slot"]).where("rank > lo AND rank < hi").join(used.select("id").distinct(), "id", "left_anti")
    order = W.partitionBy("domain", "slot").orderBy("rank")
    return inside.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).select("domain", "slot", "id", "rank")


def scoped(enabled: bool, domains: Sequence[str] | None, domain: Column) -> Column:
    """Off: nothing; no domains: everything; else the listed ones."""
    if not enabled:
        return F.lit(False)
    return F.lit(True) if domains is None else domain.isin(*domains)


def tag_terms(terms: DataFrame, nodes: DataFrame, column: str = "name") -> DataFrame:
    """terms with domain, slot and rank of the node that equals them, null where none does."""
    known = nodes.select(F.col("id").alias("_id"), "domain", "slot", "rank")
    return terms.drop("domain", "slot", "rank").join(known, F.col(column) == F.col("_id"), "left").drop("_id")


def genre_votes(names: DataFrame, nodes: DataFrame, top: int = 3) -> DataFrame:
    """(domain, n): the domains that most of the names belong to."""
    return names.join(nodes.select(F.col("id").alias("name"), "domain"), "name").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(top)


def resolve_genre(genres: DataFrame, aliases: DataFrame, domains: DataFrame) -> DataFrame:
    """genres (genre) with domain: an alias exactly, a domain exactly, an alias in part, else itself.

    aliases: (alias, domain, ord); domains: (domain). Both are lexicon assets.
    """
    exact = genres.join(F.broadcast(aliases.groupBy(F.col("alias").alias("genre")).agg(F.min_by("domain", "ord").alias("_a"))), "genre", "left")
    exact = exact.join(F.broadcast(domains.select(F.col("domain").alias("genre"), F.col("domain").alias("_d")).distinct()), "genre", "left")
    part = genres.distinct().join(F.broadcast(aliases), (F.col("genre") != "") & (F.contains("genre", F.col("alias")) | F.contains("alias", F.col("genre"))))
    part = part.groupBy("genre").agg(F.min_by("domain", "ord").alias("_p"))
    return exact.join(part, "genre", "left").select(*genres.columns, F.coalesce("_a", "_d", "_p", "genre").alias("domain"))


def is_generic(name: Column, patterns: Sequence[str], protected: Sequence[str] = ()) -> Column:
    """Blank, or matching a pattern at its start, unless it has a protected beginning."""
    hit = F.coalesce(F.btrim(name) == "", F.lit(True))
    rule = F.lit(False)
    for p in patterns:
        rule = rule | name.rlike(f"^(?:{p})")
    safe = F.lit(False)
    for p in protected:
        safe = safe | name.startswith(p)
    return hit | (rule & ~safe)


def without_generic(terms: DataFrame, words: DataFrame, column: str, patterns: Sequence[str] = (), protected: Sequence[str] = ()) -> DataFrame:
    """terms without generic names: exact words (a table with word) and patterns; protected beginnings stay."""
    safe = F.lit(False)
    for p in protected:
        safe = safe | F.col(column).startswith(p)
    kept = terms.where(~is_generic(F.col(column), patterns, protected))
    bad = words.select(F.col("word").alias("_w")).distinct()
    return kept.join(bad, (F.col(column) == F.col("_w")) & ~safe, "left_anti")
