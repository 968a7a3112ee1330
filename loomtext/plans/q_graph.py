"""Queries over events, orders, documents and nations: entities, graphs, characters, lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characters, entities, folds, graphs, lexicon, router
from ..sources.tables import read


def _acts(spark, d):
    """Events as acts: the user acts, the type is the channel, an hour is the scene."""
    hour = F.date_trunc("hour", "ts")
    return read(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("who"),
        F.col("event_type").alias("channel"),
        F.unix_timestamp(hour).alias("scene"),
        F.dayofmonth("ts").alias("chapter"),
        F.col("event_id").alias("pos"),
        F.format_string("%s:%.2f", "event_type", "value").alias("content"),
        "event_id",
        "user_id",
        "value",
    )


def _cast(spark, d):
    return _acts(spark, d).select("scene", F.col("who").alias("name")).distinct()


def cooccur_pairs(spark, d):
    return graphs.cooccurrence(_cast(spark, d), "scene", "name", least=3)


def cooccur_brands(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    members = lines.join(read(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return graphs.cooccurrence(members, "l_orderkey", "p_brand", least=2)


def directed_cooccur(spark, d):
    return graphs.directed_cooccurrence(_acts(spark, d), _cast(spark, d), "scene", "who", "name")


def character_facts(spark, d):
    acts = _acts(spark, d).withColumn("channel", F.when(F.col("channel") == "click", "say").otherwise(F.col("channel")))
    out = characters.facts(acts, _cast(spark, d))
    met = F.array_sort(F.transform(F.map_entries("co_occurrences"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select(
        "name",
        F.size("appearances").cast("long").alias("n_appearances"),
        F.array_join("sayings", "|").alias("sayings"),
        F.array_join("doings", "|").alias("doings"),
        F.array_join(met, ",").alias("met"),
    )


def last_n(spark, d):
    return characters.last_n(read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], 12)


def first_seen(spark, d):
    return graphs.nodes(_acts(spark, d).select(F.col("who").alias("name"), "chapter")).select(
        "name", F.array_join(F.col("chapters").cast("array<string>"), ",").alias("chapters"), F.col("first_seen").cast("long").alias("first_seen")
    )


def _first_lines(spark, d):
    """Documents as names whose aliases are the other documents with the same text."""
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.col("text")).alias("h"), F.length("text").alias("n"))
    group = docs.groupBy("h").agg(F.array_sort(F.collect_list(F.concat(F.lit("d"), F.col("doc_id")))).alias("all"))
    name = F.concat(F.lit("d"), F.col("doc_id"))
    return docs.join(group, "h").select(
        name.alias("name"), F.array_remove(F.col("all"), name).alias("aliases"), F.col("doc_id").alias("first_seen"), F.col("h").alias("description"), F.col("doc_id").alias("ord")
    )


def alias_edges(spark, d):
    return entities.mutual_edges(_first_lines(spark, d))


def alias_merge(spark, d):
    out = entities.merge_entities(_first_lines(spark, d))
    return out.select("canonical", F.array_join("members", ",").alias("members"), F.size("aliases").cast("long").alias("n_aliases"), "first_seen", "description")


def alias_components(spark, d):
    """Documents linked by an equal text or an equal first line."""
    from ..operators.components import components

    docs = read(spark, d, "documents").select("doc_id", F.md5(F.col("text")).alias("h"), F.md5(F.substring_index("text", "\n", 1)).alias("f"))
    edges = None
    for key in ("h", "f"):
        least = docs.groupBy(key).agg(F.min("doc_id").alias("b"))
        e = docs.join(least, key).select(F.col("doc_id").alias("a"), "b")
        edges = e if edges is None else edges.union(e)
    return components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("component"))


def text_fold(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return folds.text_fold(rows, ["conv_id"], ["turn"], "text")


def settings_fold(spark, d):
    docs = read(spark, d, "documents")
    deltas = docs.select(
        F.col("source").alias("name"), F.col("doc_id").alias("scene"), F.lit(0).alias("ord"), F.col("lang").alias("category"),
        F.substring("text", 1, 12).alias("definition"), F.array("lang").alias("aliases"),
    )
    out = folds.settings_fold(deltas)
    return out.select("name", "category", F.md5("definition").alias("definition"), F.array_join("aliases", ",").alias("aliases"), F.size("source_scenes").cast("long").alias("scenes"), "first_seen", "last_seen")


def kb_fold(spark, d):
    docs = read(spark, d, "conversations")
    deltas = docs.select(
        F.col("conv_id").alias("book"), F.col("turn").alias("scene"), F.col("role").alias("name"), F.lit("").alias("category"),
        F.array(F.lit("one who speaks")).alias("aliases"), F.col("text").alias("description"),
        *[F.lit("").alias(c) for c in ("motivation", "persona", "psychology")],
    )
    return folds.entity_fold(deltas, ["book"]).select("book", "name", "category", "first_seen", F.size("scenes").cast("long").alias("scenes"), F.md5("description").alias("description"))


def degree_weight(spark, d):
    edges = cooccur_brands(spark, d)
    members = read(spark, d, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 5).alias("chapter"))
    out = graphs.weighted_nodes(graphs.nodes(members), edges)
    return out.select("name", F.size("chapters").cast("long").alias("chapters"), "degree", "weight")


def graph_truncate(spark, d):
    members = _acts(spark, d).select(F.col("who").alias("name"), "chapter")
    return graphs.truncated_cooccurrence(graphs.nodes(members), _cast(spark, d), "scene", "name", least=3, top=40)[1]


def timeline(spark, d):
    out = graphs.timeline(_acts(spark, d), "chapter", "content", "event_id")
    return out.select(F.col("chapter").cast("long").alias("chapter"), F.array_join("events", "|").alias("events"))


def new_per_bucket(spark, d):
    first = graphs.first_occurrences(_acts(spark, d).select("who", "chapter", "event_id"), "who", ["chapter", "event_id"])
    return first.groupBy(F.col("chapter").cast("long").alias("chapter")).agg(F.count("*").alias("new"))


def wide_clusters(spark, d):
    rows = _acts(spark, d).select("who", "chapter")
    out = graphs.wide_clusters(rows, "who", "chapter", 20)
    return out.select("who", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "weight")


def activity_rule(spark, d):
    rows = read(spark, d, "events").groupBy("user_id").agg(
        F.max(F.dayofmonth("ts")).alias("last"), F.count_if(F.col("event_type") == "purchase").alias("times"),
        F.round(F.sum("value") / 10000, 6).alias("weight"), F.count_if(F.col("value") > 99).alias("confirmed"),
    )
    return characters.activity(rows, 60, recent=30, often=15, weight=0.9, confirmed=3).select("user_id", "active")


def _nodes(spark, d):
    """Regions as domains with one ordered slot of nations, and one of nations by name."""
    n = read(spark, d, "nation").join(read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    by_key = n.groupBy(F.col("r_name").alias("domain"), F.col("n_regionkey").alias("ord")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("items")
    )
    slots = by_key.select("domain", F.lit("by_key").alias("slot"), "items", F.lit(True).alias("ordered"), (F.col("ord") * 2).alias("ord"))
    other = by_key.select("domain", F.lit("old").alias("slot"), F.transform("items", lambda x: F.concat(F.lit("old "), x)).alias("items"), F.lit(True).alias("ordered"), (F.col("ord") * 2 + 1).alias("ord"))
    return lexicon.lexicon_nodes(slots.unionByName(other))


def lexicon_edges(spark, d):
    return lexicon.lexicon_edges(_nodes(spark, d))


def neighbors_2hop(spark, d):
    nodes = _nodes(spark, d)
    start = nodes.where("slot = 'by_key' AND rank <= 2").select("id")
    out = lexicon.neighbours(lexicon.lexicon_edges(nodes), start, 2)
    return out.select("start", "id", F.col("hop").cast("long").alias("hop"), "via")


def gap_detection(spark, d):
    nations = read(spark, d, "nation")
    used = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("a")).where("a > 4500")
    return lexicon.gaps(_nodes(spark, d), nations.join(used, "n_nationkey", "left_semi").select(F.col("n_name").alias("id")))


def term_tag(spark, d):
    terms = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(read(spark, d, "nation"), "n_nationkey")
    tagged = lexicon.tag_terms(terms.select("c_custkey", F.col("n_name").alias("name")), _nodes(spark, d))
    return tagged.groupBy("domain", "rank").agg(F.count("*").alias("n"))


def genre_vote(spark, d):
    names = read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).join(read(spark, d, "nation"), "n_nationkey").select(F.col("n_name").alias("name"))
    return lexicon.genre_votes(names, _nodes(spark, d))


def generic_filter(spark, d):
    parts = read(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("name"))
    words = parts.groupBy(F.col("name").alias("word")).agg(F.count("*").alias("n")).where("n >= 30").select("word")
    return lexicon.without_generic(parts, words, "name", ["[a-f]", ".*9$"], ["b"])


def router_trigger(spark, d):
    e = read(spark, d, "events")
    rows = e.select(
        "user_id", "event_id", (F.col("event_type") == "purchase").alias("is_hit"), (F.col("event_type") == "view").alias("is_unknown"),
        (F.col("event_type") == "signup").alias("is_definition"), (F.col("value") > 98).alias("is_meme"), F.lit(0).alias("gap_size"),
    )
    return router.decisions(rows, ["user_id"], ["event_id"])


_ACTS = """a AS (SELECT 'u' || user_id AS who, event_type AS channel, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS scene, CAST(day(ts) AS BIGINT) AS chapter,
  event_id, value, printf('%s:%.2f', event_type, value) AS content FROM events)"""
_CAST = "m AS (SELECT DISTINCT scene, who AS name FROM a)"
_PAIRS = "p AS (SELECT x.name AS a, y.name AS b, count(*) AS weight FROM m x JOIN m y ON x.scene = y.scene AND x.name < y.name GROUP BY ALL HAVING count(*) >= {n})"
_BRANDS = """m AS (SELECT DISTINCT l_orderkey AS scene, p_brand AS name FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_ALIAS = "d AS (SELECT 'd' || doc_id AS name, doc_id, md5(text) AS h FROM documents)"
_NODES = """
base AS (SELECT n_name AS nm, r_name AS domain, n_regionkey AS rk, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation JOIN region ON r_regionkey = n_regionkey),
n AS (SELECT nm AS id, domain, 'by_key' AS slot, rank FROM base UNION ALL SELECT 'old ' || nm, domain, 'old', rank FROM base)"""
_EDGES = """
e AS (SELECT id AS a, 'domain:' || domain AS b, 'in_domain' AS type FROM n
  UNION ALL SELECT x.id, y.id, 'next_level' FROM n x JOIN n y USING (domain, slot) WHERE y.rank = x.rank + 1
  UNION ALL SELECT x.id, y.id, 'aligned_with' FROM n x JOIN n y USING (domain, rank) WHERE x.slot < y.slot)"""

QUERIES = {
    "q_cooccur_pairs": cooccur_pairs,
    "q_cooccur_brands": cooccur_brands,
    "q_directed_cooccur": directed_cooccur,
    "q_character_facts": character_facts,
    "q_last_n": last_n,
    "q_first_seen": first_seen,
    "q_alias_edges": alias_edges,
    "q_alias_merge": alias_merge,
    "q_alias_components": alias_components,
    "q_text_fold": text_fold,
    "q_settings_fold": settings_fold,
    "q_kb_fold": kb_fold,
    "q_degree_weight": degree_weight,
    "q_graph_truncate": graph_truncate,
    "q_timeline": timeline,
    "q_new_per_bucket": new_per_bucket,
    "q_wide_clusters": wide_clusters,
    "q_activity_rule": activity_rule,
    "q_lexicon_edges": lexicon_edges,
    "q_neighbors_2hop": neighbors_2hop,
    "q_gap_detection": gap_detection,
    "q_term_tag": term_tag,
    "q_genre_vote": genre_vote,
    "q_generic_filter": generic_filter,
    "q_router_trigger": router_trigger,
}

_FOLD = """list_reduce(list_prepend('', list({x} ORDER BY {o})), lambda acc, x: CASE WHEN x IS NULL OR x = '' OR contains(acc, x) THEN acc WHEN acc = '' THEN x ELSE acc || '；' || x END)"""

ORACLES = {
    "q_cooccur_pairs": f"WITH {_ACTS}, {_CAST}, {_PAIRS.format(n=3)} SELECT * FROM p",
    "q_cooccur_brands": f"WITH {_BRANDS}, {_PAIRS.format(n=2)} SELECT * FROM p",
    "q_directed_cooccur": f"""WITH {_ACTS}, {_CAST}
SELECT who AS actor, name AS other, count(*) AS acts FROM a JOIN m USING (scene) WHERE who <> name GROUP BY ALL""",
    "q_character_facts": f"""WITH {_ACTS}, {_CAST},
t AS (SELECT who, who AS name, count(DISTINCT (chapter, scene)) AS n_appearances FROM a GROUP BY who),
r AS (SELECT *, channel = 'click' AS said, row_number() OVER (PARTITION BY who, channel = 'click' ORDER BY chapter DESC, scene DESC, event_id DESC) AS k FROM a),
s AS (SELECT who, string_agg(content, '|' ORDER BY chapter, scene, event_id) FILTER (said) AS sayings,
        string_agg(content, '|' ORDER BY chapter, scene, event_id) FILTER (NOT said) AS doings FROM r WHERE k <= 12 GROUP BY who),
c AS (SELECT who, name AS other, count(*) AS n FROM a JOIN m USING (scene) WHERE who <> name GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY n DESC, other) AS k FROM c),
z AS (SELECT who, string_agg(other || '=' || n, ',' ORDER BY other || '=' || n) AS met FROM q WHERE k <= 8 GROUP BY who)
SELECT name, n_appearances, coalesce(sayings, '') AS sayings, coalesce(doings, '') AS doings, coalesce(met, '') AS met
FROM t LEFT JOIN s USING (who) LEFT JOIN z USING (who)""",
    "q_last_n": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 12",
    "q_first_seen": f"WITH {_ACTS} SELECT who AS name, string_agg(DISTINCT chapter, ',' ORDER BY chapter) AS chapters, min(chapter) AS first_seen FROM a GROUP BY who",
    "q_alias_edges": f"WITH {_ALIAS} SELECT x.name AS a, y.name AS b FROM d x JOIN d y USING (h) WHERE x.name < y.name",
    "q_alias_merge": f"""WITH {_ALIAS},
g AS (SELECT h, count(*) AS n, min(doc_id) AS first_seen, string_agg(name, ',' ORDER BY name) AS members, arg_max(name, (len(name), -doc_id)) AS canonical FROM d GROUP BY h)
SELECT canonical, members, n - 1 AS n_aliases, first_seen, h AS description FROM g""",
    "q_alias_components": """
WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS h, md5(string_split(text, chr(10))[1]) AS f FROM documents),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y ON x.h = y.h UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.f = y.f),
r AS (SELECT a AS doc_id, b AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, min(reach) AS component FROM r GROUP BY doc_id""",
    "q_text_fold": f"WITH t AS (SELECT conv_id, turn, text AS x FROM conversations) SELECT conv_id, {_FOLD.format(x='x', o='turn')} AS text FROM t GROUP BY conv_id",
    "q_settings_fold": f"""
WITH t AS (SELECT source AS name, doc_id, lang, substr(text, 1, 12) AS x FROM documents),
l AS (SELECT name, lang, min(doc_id) AS f FROM t GROUP BY ALL),
k AS (SELECT name, string_agg(lang, ',' ORDER BY f) AS aliases FROM l GROUP BY name)
SELECT name, arg_min(lang, doc_id) AS category, md5({_FOLD.format(x='x', o='doc_id')}) AS definition, any_value(aliases) AS aliases, count(*) AS scenes,
  min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM t JOIN k USING (name) GROUP BY name""",
    "q_degree_weight": f"""WITH {_BRANDS}, {_PAIRS.format(n=2)},
g AS (SELECT name, count(*) AS degree FROM (SELECT a AS name FROM p UNION ALL SELECT b FROM p) GROUP BY name),
c AS (SELECT p_brand AS name, count(DISTINCT p_size % 5) AS chapters FROM part GROUP BY p_brand)
SELECT name, chapters, coalesce(degree, 0) AS degree, chapters + coalesce(degree, 0) AS weight FROM c LEFT JOIN g USING (name)""",
    "q_graph_truncate": f"""WITH {_ACTS}, {_CAST}, {_PAIRS.format(n=3)},
g AS (SELECT name, count(*) AS degree FROM (SELECT a AS name FROM p UNION ALL SELECT b FROM p) GROUP BY name),
c AS (SELECT who AS name, count(DISTINCT chapter) AS n FROM a GROUP BY who),
k AS (SELECT name FROM c LEFT JOIN g USING (name) ORDER BY n + coalesce(degree, 0) DESC, name LIMIT 40)
SELECT a, b, weight FROM p WHERE a IN (FROM k) AND b IN (FROM k)""",
    "q_timeline": f"WITH {_ACTS} SELECT chapter, string_agg(content, '|' ORDER BY event_id) AS events FROM a GROUP BY chapter",
    "q_new_per_bucket": f"WITH {_ACTS}, f AS (SELECT who, min(chapter) AS chapter FROM a GROUP BY who) SELECT chapter, count(*) AS new FROM f GROUP BY chapter",
    "q_wide_clusters": f"WITH {_ACTS} SELECT who, min(chapter) AS first, max(chapter) AS last, count(*) AS weight FROM a GROUP BY who HAVING max(chapter) - min(chapter) >= 20",
    "q_activity_rule": """
SELECT user_id, 60 - max(day(ts)) <= 30 OR count(*) FILTER (event_type = 'purchase') >= 15 OR round(sum(value) / 10000, 6) >= 0.9 OR count(*) FILTER (value > 99) >= 3 AS active
FROM events GROUP BY user_id""",
    "q_lexicon_edges": f"WITH {_NODES}, {_EDGES} SELECT * FROM e",
    "q_neighbors_2hop": f"""WITH {_NODES}, {_EDGES},
u AS (SELECT a AS f, b AS t, type FROM e UNION ALL SELECT b, a, type FROM e),
s AS (SELECT id AS start FROM n WHERE slot = 'by_key' AND rank <= 2),
h1 AS (SELECT start, t AS id, 1 AS hop, min(type) AS via FROM s JOIN u ON f = start WHERE t <> start GROUP BY ALL),
h2 AS (SELECT start, t AS id, 2 AS hop, min(type) AS via FROM h1 JOIN u ON f = id WHERE NOT starts_with(id, 'domain:') AND t <> start
       AND (start, t) NOT IN (SELECT (start, id) FROM h1) GROUP BY start, t)
SELECT start, id, CAST(hop AS BIGINT) AS hop, via FROM h1 UNION ALL SELECT start, id, CAST(hop AS BIGINT), via FROM h2""",
    "q_gap_detection": f"""WITH {_NODES},
used AS (SELECT n_name AS id FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING avg(c_acctbal) > 4500),
s AS (SELECT domain, slot, min(rank) AS lo, max(rank) AS hi FROM n WHERE id IN (FROM used) GROUP BY ALL HAVING count(*) >= 2)
SELECT domain, slot, id, rank FROM n JOIN s USING (domain, slot) WHERE rank > lo AND rank < hi AND id NOT IN (FROM used)""",
    "q_term_tag": f"WITH {_NODES} SELECT domain, rank, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN n ON n.id = n_name GROUP BY ALL",
    "q_genre_vote": f"WITH {_NODES} SELECT domain, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN n ON n.id = n_name GROUP BY domain ORDER BY n DESC, domain LIMIT 3",
    "q_generic_filter": """
WITH p AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS name FROM part)
SELECT p_partkey, name FROM p WHERE trim(name) <> '' AND (starts_with(name, 'b')
  OR (NOT regexp_matches(name, '^(?:[a-f])') AND NOT regexp_matches(name, '^(?:.*9$)') AND name NOT IN (SELECT name FROM p GROUP BY name HAVING count(*) >= 30)))""",
    "q_router_trigger": """
WITH c AS (SELECT user_id, event_id, sum(CAST(event_type = 'purchase' AS INT)) OVER w AS h, sum(CAST(event_type = 'view' AS INT)) OVER w AS u,
  sum(CAST(event_type = 'signup' AS INT)) OVER w AS f, sum(CAST(value > 98 AS INT)) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT user_id, event_id, CASE WHEN h >= 3 THEN 'R1' WHEN u >= 8 THEN 'R2' WHEN f >= 3 THEN 'R4' WHEN m >= 2 THEN 'R5' END AS rule FROM c)
SELECT user_id, event_id, rule FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM r WHERE rule IS NOT NULL) WHERE k = 1""",
}
