"""Entity resolution: alias edges, components, canonical names, merged entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import in_blocks

from .components import components

_NOISE = r"[\s,.;:!?，。；：！？、()（）\[\]【】“”\"']"


def alias_union(registry: DataFrame, category: str | None = "人物") -> DataFrame:
    """(name, aliases): the union of a name's aliases over all chapters, without itself.

    registry: (chapter_no, canonical, aliases, category).
    """
    rows = registry if category is None else registry.where(F.col("category") == category)
    pairs = rows.select(F.btrim("canonical").alias("name"), F.explode_outer("aliases").alias("alias")).where("name <> ''")
    alias = F.nullif(F.btrim("alias"), F.lit(""))
    return pairs.groupBy("name").agg(F.array_sort(F.collect_set(F.when(alias != F.col("name"), alias))).alias("aliases"))


def registry_flat(registry: DataFrame) -> DataFrame:
    """(canonical, aliases, category): aliases over all chapters, the first non-empty category."""
    some = F.when(F.btrim("category") != "", F.struct("chapter_no", "category"))
    sets = alias_union(registry, None)
    first = registry.groupBy(F.btrim("canonical").alias("name")).agg(F.min(some)["category"].alias("category"))
    return sets.join(first, "name", "left").withColumnRenamed("name", "canonical")


def alias_pairs(names: DataFrame) -> DataFrame:
    """(name, alias) of a table (name, aliases)."""
    return names.select("name", F.explode("aliases").alias("alias")).where("alias <> '' AND alias <> name").distinct()


def mutual_edges(aliases: DataFrame, known: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: names that list each other, both known, without blacklisted pairs.

    aliases: (name, aliases); known: (name); blacklist: (a, b) in any order. An equi-join
    of alias pairs with the reversed pairs, not a comparison of all names.
    """
    pairs = alias_pairs(aliases)
    back = pairs.select(F.col("alias").alias("name"), F.col("name").alias("alias"))
    out = pairs.join(back, ["name", "alias"]).where("name < alias").select(F.col("name").alias("a"), F.col("alias").alias("b"))
    if known is not None:
        out = out.join(known.select(F.col("name").alias("a")), "a", "left_semi").join(known.select(F.col("name").alias("b")), "b", "left_semi")
    return without_pairs(out.select("a", "b"), blacklist)


def without_pairs(edges: DataFrame, blacklist: DataFrame | None) -> DataFrame:
    if blacklist is None:
        return edges
    bad = blacklist.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    ordered = (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))
    return edges.join(bad, ordered, "left_anti")


def alias_edges(chars: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """(a, b): a name and an alias of it that is a known name itself."""
    pairs = alias_pairs(chars).select(F.col("name").alias("a"), F.col("alias").alias("b"))
    known = chars.select(F.col("name").alias("b")).distinct()
    return without_pairs(pairs.join(known, "b", "left_semi").select("a", "b"), blacklist)


def merge_entities(chars: DataFrame, extra_edges: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """One row per entity: canonical, members, aliases, first_seen, description.

    chars: (name, aliases, first_seen, description, ord). Names join through alias edges
    and extra edges. The canonical name is listed most often as an alias inside its
    component, then longest, then seen first, then first in order. Aliases are those of
    all members and the other members, longest first; the longest description stays.
    """
    edges = alias_edges(chars, blacklist)
    if extra_edges is not None:
        edges = edges.union(without_pairs(extra_edges.select("a", "b"), blacklist))
    parts = components(edges)
    rooted = chars.join(parts.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    listed = (
        alias_pairs(chars)
        .join(rooted.select("name", "root"), "name")
        .join(rooted.select(F.col("name").alias("alias"), F.col("root").alias("other")), "alias")
        .where("root = other")
        .groupBy(F.col("alias").alias("name"))
        .agg(F.count("*").alias("listed"))
    )
    ranked = rooted.join(listed, "name", "left").withColumn(
        "rank", F.struct(F.coalesce("listed", F.lit(0)).alias("a"), F.length("name").alias("b"), (-F.coalesce("first_seen", F.lit(999))).alias("c"), (-F.col("ord")).alias("d"))
    )
    longest = F.struct(F.length(F.coalesce("description", F.lit(""))).alias("n"), (-F.col("ord")).alias("o"))
    merged = ranked.groupBy("root").agg(
        F.max_by("name", "rank").alias("canonical"),
        F.array_sort(F.collect_set("name")).alias("members"),
        F.flatten(F.collect_list("aliases")).alias("all"),
        F.min("first_seen").alias("first_seen"),
        F.max_by("description", longest).alias("description"),
    )
    names = F.array_distinct(F.concat("members", "all"))
    return merged.select("canonical", "members", ordered_aliases(F.filter(names, lambda x: (x != "") & (x != F.col("canonical")))).alias("aliases"), "first_seen", "description")


def ordered_aliases(names):
    """Longest first, then by code point."""
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def enrich(entities: DataFrame, aliases: DataFrame, *, max_length: int = 12, noise: str = _NOISE) -> DataFrame:
    """entities with the aliases that a table (name, aliases) lists for any of their members.

    Aliases over the length, with noise characters, or that are another entity's canonical
    name are left out.
    """
    more = (
        entities.select("canonical", F.explode("members").alias("name"))
        .join(alias_pairs(aliases), "name")
        .where((F.length("alias") <= max_length) & ~F.col("alias").rlike(noise))
        .join(entities.select(F.col("canonical").alias("alias")), "alias", "left_anti")
        .groupBy("canonical")
        .agg(F.collect_set("alias").alias("more"))
    )
    none = F.array().cast("array<string>")
    return entities.join(more, "canonical", "left").withColumn("aliases", ordered_aliases(F.array_union("aliases", F.coalesce("more", none)))).drop("more")


def canonical_map(entities: DataFrame) -> DataFrame:
    """(name, canonical): every member and alias, and canonical names themselves, the first by name."""
    rows = entities.select("canonical", F.explode(F.array_distinct(F.concat(F.array("canonical"), "members", "aliases"))).alias("name"))
    prefer = F.struct((F.col("name") != F.col("canonical")).alias("a"), F.col("canonical").alias("b"))
    return rows.groupBy("name").agg(F.min_by("canonical", prefer).alias("canonical"))


def resolve(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """rows with the column's names replaced by their canonical names where known."""
    known = names.select(F.col("name").alias("_n"), F.col("canonical").alias("_c"))
    return rows.join(known, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_c", column)).drop("_n", "_c")


def first_match(rows: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    """rows with term: the first by ord of (term, aliases, ord) whose name or alias equals the column."""
    names = terms.select("term", "ord", F.explode(F.array_distinct(F.concat(F.array("term"), "aliases"))).alias("_n"))
    first = names.groupBy("_n").agg(F.min_by("term", "ord").alias("term"))
    return rows.join(first, F.col(column) == F.col("_n"), "left").drop("_n")


def first_containing(rows: DataFrame, names: DataFrame, key: str, column: str, *, block: int = 50_000) -> DataFrame:
    """(key, column, owner): the first by ord of (name, ord) that contains the text or is contained in it.

    A theta join over a side that is small by nature; it is sent in blocks of about `block`
    names at most, and the first of each block is the most that a block hands on.
    """
    inside = (F.col(column) != "") & (F.contains(F.col(column), F.col("name")) | F.contains(F.col("name"), F.col(column)))
    texts = rows.select(key, column)
    parts = [texts.join(F.broadcast(part), inside) for part in in_blocks(names.select("name", "ord"), "name", block)]
    best = [part.groupBy(key, column).agg(F.min_by("name", "ord").alias("owner"), F.min("ord").alias("ord")) for part in parts]
    return reduce(DataFrame.union, best).groupBy(key, column).agg(F.min_by("owner", "ord").alias("owner"))


def merge_personality(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(canonical, dim, score): means of the scores (name, dim, score) of an entity's names."""
    return resolve(rows, names, "name").groupBy(F.col("name").alias("canonical"), "dim").agg(F.round(F.avg("score"), 1).alias("score"))
