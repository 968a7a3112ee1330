"""Ordered folds: accumulated texts, knowledge bases, settings graphs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATOR = "；"


def folded(texts: Column, separator: str = SEPARATOR) -> Column:
    """Texts joined in order; one that the text so far contains is passed over."""
    return F.aggregate(
        texts,
        F.lit(""),
        lambda acc, x: F.when(x.isNull() | (x == "") | F.contains(acc, x), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(separator), x)),
    )


def text_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str = SEPARATOR) -> DataFrame:
    """(keys, text): the fold of a key's texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(*keys).agg(folded(F.transform(ordered, lambda x: x[text]), separator).alias(text))


def union_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], items: str) -> DataFrame:
    """(keys, items): the items of a key's lists, distinct, in order of first occurrence."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, items)))
    return rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x[items]))).alias(items))


def longest(rows: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """(keys, text): the longest text, the first of equal ones."""
    best = F.struct(F.length(F.coalesce(text, F.lit(""))).alias("n"), (-F.col(order)).alias("o"))
    return rows.groupBy(*keys).agg(F.max_by(text, best).alias(text))


def entity_fold(deltas: DataFrame, group: Sequence[str], *, default_category: str = "人物", separator: str = SEPARATOR, texts=("description", "motivation", "persona", "psychology")) -> DataFrame:
    """Knowledge-base entities folded from deltas in scene order, exact alias chaining.

    deltas: group..., scene, name, category, aliases and the text columns. A delta belongs
    to the first entity of its category that has its name as name or alias; aliases learnt
    in one scene count for later ones, so the fold is one ordered pass per group (a book).
    """
    kinds = ", ".join(f"{k} {deltas.schema[k].dataType.simpleString()}" for k in group)
    scene = deltas.schema["scene"].dataType.simpleString()
    schema = f"{kinds}, name string, category string, aliases array<string>, first_seen {scene}, scenes array<{scene}>, " + ", ".join(f"{t} string" for t in texts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entities: list[dict] = []
        by_name: dict[tuple, dict] = {}
        for row in pdf.sort_values("scene", kind="stable").to_dict("records"):
            name = (row["name"] or "").strip()
            if not name:
                continue
            category = (row["category"] or "").strip() or default_category
            e = by_name.get((name, category))
            if e is None:
                e = {"name": name, "category": category, "aliases": [], "first_seen": row["scene"], "scenes": []} | dict.fromkeys(texts, "")
                entities.append(e)
                by_name[name, category] = e
            given = row["aliases"] if row["aliases"] is not None else []
            for a in ([name] if name != e["name"] else []) + [str(x).strip() for x in given]:
                if a and a != e["name"] and a not in e["aliases"]:
                    e["aliases"].append(a)
                by_name.setdefault((a, category), e)
            if row["scene"] not in e["scenes"]:
                e["scenes"].append(row["scene"])
            for t in texts:
                x = (row[t] or "").strip()
                if x and x not in e[t]:
                    e[t] = x if not e[t] else e[t] + separator + x
        out = pd.DataFrame(entities, columns=["name", "category", "aliases", "first_seen", "scenes", *texts])
        for i, k in enumerate(group):
            out.insert(i, k, pdf[k].iat[0])
        return out

    return deltas.select(*group, "scene", "name", "category", "aliases", *texts).groupBy(*group).applyInPandas(run, schema)


def settings_fold(deltas: DataFrame, canonical: DataFrame | None = None, separator: str = SEPARATOR) -> DataFrame:
    """Setting terms folded from deltas (scene, name, category, definition, aliases, ord).

    Names are first brought to canonical ones by a table (name, canonical), which lets
    every term fold on its own; first_seen is the first scene, last_seen the last.
    """
    rows = deltas
    if canonical is not None:
        rows = rows.join(canonical.select(F.col("name").alias("_n"), "canonical"), F.col("name") == F.col("_n"), "left").withColumn("_own", F.col("name")).withColumn("name", F.coalesce("canonical", "name")).drop("_n", "canonical")
    else:
        rows = rows.withColumn("_own", F.col("name"))
    ordered = F.array_sort(F.collect_list(F.struct("scene", "ord", "category", "definition", "aliases", "_own")))
    out = rows.where("name <> ''").groupBy("name").agg(ordered.alias("d"))
    names = F.array_distinct(F.flatten(F.transform("d", lambda x: F.concat(F.array(x["_own"]), F.coalesce(x["aliases"], F.array().cast("array<string>"))))))
    return out.select(
        "name",
        F.get(F.filter("d", lambda x: F.coalesce(x["category"], F.lit("")) != ""), F.lit(0))["category"].alias("category"),
        folded(F.transform("d", lambda x: x["definition"]), separator).alias("definition"),
        F.filter(names, lambda a: (a != "") & (a != F.col("name"))).alias("aliases"),
        F.array_distinct(F.transform("d", lambda x: x["scene"])).alias("source_scenes"),
        F.get("d", F.lit(0))["scene"].alias("first_seen"),
        F.element_at("d", -1)["scene"].alias("last_seen"),
    )


def directed_relations(relations: DataFrame) -> DataFrame:
    """(from, to, type, how, scene) of (…, ord): the first of each directed pair."""
    order = W.partitionBy("from", "to").orderBy("ord")
    return relations.where("`from` <> `to`").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def synonym_merge(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Terms of one category joined through synonyms (a, b): source scenes united, texts folded.

    terms: (name, category, definition, source_scenes, ord).
    """
    from .components import components

    cat = terms.select("name", "category")
    same = (
        synonyms.join(cat.select(F.col("name").alias("a"), F.col("category").alias("_a")), "a")
        .join(cat.select(F.col("name").alias("b"), F.col("category").alias("_b")), "b")
        .where("_a = _b")
        .select("a", "b")
    )
    rooted = terms.join(components(same).withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "name", "definition")))
    merged = rooted.groupBy("root", "category").agg(ordered.alias("d"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_scenes")))).alias("source_scenes"))
    return merged.select(
        F.get("d", F.lit(0))["name"].alias("name"),
        "category",
        folded(F.transform("d", lambda x: x["definition"])).alias("definition"),
        F.transform(F.slice("d", 2, F.size("d")), lambda x: x["name"]).alias("aliases"),
        "source_scenes",
    )
