"""Queries over events, lineitem, documents, part and embeddings: retrieval, logs, comparisons, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..functions import tolerant_json as J
from ..operators import lexicon, retrieval, router, runlog
from ..sources.tables import by_chapter, read

TERMS = ["tion", "the", "ering", "und", "der"]


def knn(spark, d):
    vectors = read(spark, d, "embeddings")
    query = vectors.where("vec_id = 7").select("embedding").first()["embedding"]
    return retrieval.nearest(vectors, "vec_id", "embedding", query, 10).withColumn("score", F.round("score", 6))


def knn_each(spark, d):
    vectors = read(spark, d, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    out = retrieval.nearest_each(vectors, queries, "vec_id", "q", "embedding", 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


def bm25(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    postings, lengths = retrieval.build_index(docs, "doc_id", "text", terms=TERMS)
    return retrieval.bm25(postings, lengths, "doc_id", TERMS, limit=20)


def like_fallback(spark, d):
    return retrieval.containing(read(spark, d, "documents"), "doc_id", "text", "tion the", 10)


def layered_search(spark, d):
    parts = read(spark, d, "part")
    nodes = parts.groupBy(F.col("p_name").alias("id")).agg(F.min("p_partkey").alias("ord"))
    queries = parts.where("p_partkey % 20 = 0").select(F.col("p_name").alias("query"))
    out = retrieval.layered_search(queries, nodes, top=5)
    return out.withColumn("rank", F.col("rank").cast("long"))


def search_external(spark, d):
    parts = read(spark, d, "part")
    nodes = parts.groupBy(F.col("p_name").alias("id")).agg(F.min("p_partkey").alias("ord"))
    queries = parts.where("p_partkey % 20 = 0").select(F.col("p_name").alias("query")).distinct()
    hits = retrieval.layered_search(queries, nodes, top=5)
    local = parts.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("definition"))
    local = local.unionByName(parts.where("p_size = 1").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("definition")))
    return router.search_external(queries, local, hits).withColumn("layer", F.col("layer").cast("long"))


def context_for_term(spark, d):
    out = retrieval.context_for_term(read(spark, d, "documents"), "thing", ["text", "source"], order=["doc_id"], limit=6)
    return out.select("doc_id", F.size("blobs").cast("long").alias("blobs"))


def rag_context(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", "text")
    postings, lengths = retrieval.build_index(docs, "doc_id", "text", terms=TERMS)
    hits = retrieval.bm25(postings, lengths, "doc_id", TERMS, limit=6)
    return retrieval.rag_context(hits, docs, "doc_id", "text", "n_chars")


def health_h1(spark, d):
    return runlog.health(read(spark, d, "events"), ["event_type"], F.col("value") < 10, limit=0.1)


def log_span(spark, d):
    out = runlog.span(read(spark, d, "events"))
    return out.select("n", "minutes")


def last_progress(spark, d):
    out = runlog.last_progress(read(spark, d, "events"), "event_type", "ts", ["user_id", "value"], "event_id")
    return out.select("event_type", "user_id", "value")


def error_matrix(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", F.round("value", 2).cast("string").alias("msg"))
    return runlog.error_matrix(e, "user_id", "event_type", "msg", ["event_id"], ["click", "purchase", "view"])


def token_ledger(spark, d):
    usage = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("long").alias("prompt"), F.col("l_quantity").cast("long").alias("completion"))
    return runlog.token_ledger(usage)


def registry_stats(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select(F.col("lang").alias("chapter_no"), F.col("source").alias("canonical"), F.split("text", " ").alias("aliases"))
    return runlog.registry_stats(rows)


def _words(spark, d, lang):
    return read(spark, d, "documents").where(F.col("lang") == lang).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))


def jaccard(spark, d):
    return runlog.jaccard(_words(spark, d, "en"), _words(spark, d, "de"), "w")


def hit_rate(spark, d):
    wanted = read(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("name")).distinct()
    registry = read(spark, d, "part").select(F.col("p_brand").alias("canonical"), F.array("p_type", "p_name").alias("aliases"))
    return runlog.hit_rate(wanted, registry)


def json_props(spark, d):
    e = read(spark, d, "events")
    k = F.try_variant_get(F.try_parse_json(J.as_object(F.col("props"))), "$.k", "int")
    return e.select("event_type", k.cast("long").alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


def json_salvage(spark, d):
    """Arrays of one to four objects, cut off at a place that runs over all of the answer."""
    e = read(spark, d, "events")
    item = lambda i: F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit(f'{i}", "at": {i}}}'))
    whole = F.concat(F.lit("["), F.array_join(F.slice(F.array(*map(item, range(4))), 1, (F.pmod("event_id", F.lit(4)) + 1).cast("int")), ", "), F.lit("]"))
    raw = F.concat(F.lit("```json\n"), F.expr("left(whole, 1 + pmod(event_id * 7, length(whole)))"))
    e = e.withColumn("whole", whole).select("event_id", J.as_array(raw).alias("items"))
    return e.select("event_id", F.size("items").cast("long").alias("n"), J.text_of(F.get("items", F.lit(0)), ["title", "name"]).alias("first"))


def who_clean(spark, d):
    people = F.collect_list(F.struct("turn", F.struct(F.lpad(F.col("role"), 10, " ").alias("name"), F.when(F.col("turn") == 0, clean.LEAD).otherwise("?").alias("role"))))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(people), lambda x: x["col2"]).alias("people"))
    cleaned = clean.who(F.col("people"))
    return rows.select("conv_id", F.array_join(F.transform(cleaned, lambda p: F.concat_ws("=", p["name"], p["role"])), ",").alias("who"), clean.point_of_view(F.lit("a tall person"), cleaned, "tall").alias("pov"))


def list_clean(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(clean.list_items(F.split(F.col("text"), " "), 8, 3), "|").alias("items"))


def by_chapter_counts(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("chapter_no"), F.col("turn").alias("scene_id"), "role")
    out = by_chapter(rows)
    return out.select("chapter_no", F.array_join(F.transform("scenes", lambda s: s["role"]), ",").alias("roles"))


def stream_token_ledger(spark, d):
    """The token ledger fed as a stream; the same result as in one batch."""
    from ..streaming import ledger

    return ledger.replay(spark, f"{d}/events.parquet")


def stream_sessions(spark, d):
    from ..streaming import sessions

    return sessions.replay(spark, f"{d}/events.parquet", gap="30 minutes")


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_SIM = f"{_COS.format(a='v.embedding', b='q.embedding')} / (sqrt({_COS.format(a='v.embedding', b='v.embedding')}) * sqrt({_COS.format(a='q.embedding', b='q.embedding')}))"
_SEARCH = """
n AS (SELECT p_name AS id, min(p_partkey) AS ord FROM part GROUP BY p_name),
q AS (SELECT DISTINCT p_name AS query FROM part WHERE p_partkey % 20 = 0),
s AS (SELECT query, id, ord, CASE WHEN query = id THEN 1.0 WHEN starts_with(id, query) OR starts_with(query, id) THEN 0.8
  WHEN contains(id, query) OR contains(query, id) THEN 0.6 WHEN len(query) >= 2 AND levenshtein(query, id) <= 1 THEN 0.45 END AS score FROM q, n),
l AS (SELECT *, row_number() OVER (PARTITION BY query, score ORDER BY ord) AS k FROM s WHERE score IS NOT NULL),
c AS (SELECT *, count(*) FILTER (score > 0.45) OVER (PARTITION BY query) AS b FROM l WHERE k <= 15),
r AS (SELECT query, id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM c WHERE score > 0.45 OR b < 5),
h AS (SELECT * FROM r WHERE rank <= 5)"""

QUERIES = {
    "q_knn": knn,
    "q_knn_each": knn_each,
    "q_bm25": bm25,
    "q_like_fallback": like_fallback,
    "q_layered_search": layered_search,
    "q_search_external": search_external,
    "q_context_for_term": context_for_term,
    "q_rag_context": rag_context,
    "q_health_h1": health_h1,
    "q_log_span": log_span,
    "q_last_progress": last_progress,
    "q_error_matrix": error_matrix,
    "q_token_ledger": token_ledger,
    "q_registry_stats": registry_stats,
    "q_jaccard": jaccard,
    "q_hit_rate": hit_rate,
    "q_json_props": json_props,
    "q_json_salvage": json_salvage,
    "q_who_clean": who_clean,
    "q_list_clean": list_clean,
    "q_by_chapter": by_chapter_counts,
    "q_stream_token_ledger": stream_token_ledger,
    "q_stream_sessions": stream_sessions,
}

ORACLES = {
    "q_knn": f"SELECT v.vec_id, round({_SIM}, 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id = 7) q ORDER BY {_SIM} DESC, v.vec_id DESC LIMIT 10",
    "q_knn_each": f"""WITH s AS (SELECT q.vec_id AS q, v.vec_id, round({_SIM}, 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id DESC) AS rank FROM s) WHERE rank <= 5""",
    "q_bm25": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n FROM documents),
z AS (SELECT count(*) AS docs, avg(n) AS av FROM n),
p AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN ('tion', 'the', 'ering', 'und', 'der') GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / av))), 6) AS score
FROM p JOIN f USING (term) JOIN n USING (doc_id), z GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
    "q_like_fallback": "SELECT doc_id FROM documents WHERE contains(text, 'tion the') ORDER BY doc_id LIMIT 10",
    "q_layered_search": f"WITH {_SEARCH} SELECT query, id, score, rank FROM h",
    "q_search_external": f"""WITH {_SEARCH},
b AS (SELECT query, string_agg(id, ',' ORDER BY rank) AS l2 FROM h GROUP BY query),
k AS (SELECT p_brand AS query, min(p_type) AS l1 FROM part GROUP BY p_brand UNION ALL SELECT p_name, min(p_type) FROM part WHERE p_size = 1 GROUP BY p_name)
SELECT query, CAST(CASE WHEN l1 IS NOT NULL THEN 1 WHEN l2 IS NOT NULL THEN 2 ELSE 0 END AS BIGINT) AS layer, coalesce(l1, l2, '') AS answer FROM q LEFT JOIN b USING (query) LEFT JOIN k USING (query)""",
    "q_context_for_term": "SELECT doc_id, CAST(1 AS BIGINT) AS blobs FROM documents WHERE contains(text, 'thing') ORDER BY doc_id LIMIT 6",
    "q_health_h1": "SELECT event_type, count(*) AS n, count(*) FILTER (value < 10) AS bad, round(count(*) FILTER (value < 10) / count(*), 4) AS rate, count(*) FILTER (value < 10) / count(*) < 0.1 AS ok FROM events GROUP BY event_type",
    "q_log_span": "SELECT count(*) AS n, round((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 60, 2) AS minutes FROM events",
    "q_last_progress": "SELECT event_type, arg_max(user_id, (ts, event_id)) AS user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type",
    "q_error_matrix": """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view,
  count(*) AS n, arg_max(CAST(round(value, 2) AS VARCHAR), event_id) AS last FROM events GROUP BY user_id""",
    "q_token_ledger": """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS model, CAST(sum(l_linenumber) AS BIGINT) AS prompt,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS completion, count(*) AS calls FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
    "q_registry_stats": """WITH a AS (SELECT unnest(string_split(text, ' ')) AS x FROM documents)
SELECT count(*) AS total, count(DISTINCT source) AS canonical, (SELECT count(DISTINCT x) FROM a) AS aliases, round(count(*) / count(DISTINCT lang), 2) AS per_chapter FROM documents""",
    "q_jaccard": """WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en'),
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'de'),
c AS (SELECT count(*) AS "both" FROM a JOIN b USING (w)), e AS (SELECT count(*) AS either FROM (FROM a UNION FROM b))
SELECT "both", either, round("both" / either, 3) AS jaccard FROM c, e""",
    "q_hit_rate": """WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part), n AS (SELECT p_brand AS x FROM part UNION SELECT p_type FROM part UNION SELECT p_name FROM part)
SELECT name, EXISTS (SELECT 1 FROM n WHERE contains(x, name)) AS hit FROM w""",
    "q_json_props": """SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract(props, '$.k')) AS n FROM events GROUP BY event_type""",
    "q_json_salvage": """WITH e AS (SELECT event_id, event_type, 1 + event_id % 4 AS k, 22 + len(event_type) AS size FROM events),
l AS (SELECT *, 1 + (event_id * 7) % (2 + k * size + (k - 1) * 2) AS cut FROM e)
SELECT event_id, CAST(greatest(0, least(k, (cut - 1 + 2) // (size + 2))) AS BIGINT) AS n,
  CASE WHEN (cut - 1 + 2) // (size + 2) >= 1 THEN event_type || '0' END AS first FROM l""",
    "q_who_clean": """WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL)
SELECT conv_id, string_agg(role || '=' || CASE WHEN t = 0 THEN '主事' ELSE '参与' END, ',' ORDER BY t) AS who, arg_min(role, t) AS pov FROM f GROUP BY conv_id""",
    "q_list_clean": """WITH i AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, unnest(range(0, len(string_split(text, ' ')))) AS p FROM documents),
k AS (SELECT doc_id, trim(x) AS x, min(p) AS p FROM i WHERE len(trim(x)) >= 3 GROUP BY doc_id, trim(x)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM k),
o AS (SELECT doc_id, string_agg(x, '|' ORDER BY p) AS items FROM r WHERE k <= 8 GROUP BY doc_id)
SELECT doc_id, coalesce(items, '') AS items FROM documents LEFT JOIN o USING (doc_id)""",
    "q_by_chapter": "SELECT conv_id AS chapter_no, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    "q_stream_token_ledger": "SELECT event_type AS model, count(*) AS calls, CAST(sum(event_id % 7) AS BIGINT) AS prompt FROM events GROUP BY event_type",
    "q_stream_sessions": """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS started, count(*) AS events FROM r GROUP BY user_id, k""",
}

ORACLES["q_rag_context"] = f"""WITH hits AS ({ORACLES["q_bm25"]})
SELECT string_agg('[第' || n_chars || '章·scene' || doc_id || '] ' || text, chr(10) ORDER BY score DESC, doc_id) AS context
FROM (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT 6) JOIN documents USING (doc_id)"""
