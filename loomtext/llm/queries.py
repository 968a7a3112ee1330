"""The thin queries that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def _scored(found: DataFrame, held_out, threshold: float) -> DataFrame:
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", (~language_id.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = documents(spark, sf_dir)
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return _scored(found, ~quality.learnable(F.col("doc_id")), quality.THRESHOLD)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _scored(found, ~toxicity.learnable(F.col("doc_id")), toxicity.THRESHOLD)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    out = simhash.components(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    out = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["last"]))
    return out.select("doc_id", "text", "n_lines", "n_removed", F.array_join(spans, ",").alias("removed"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_ columns count base spans, and n_all the base spans and those that the method adds."""
    from . import pii

    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_all"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    marks = exact_dedup.mark(documents(spark, sf_dir).select("doc_id", "text"), digest_all=True)
    return marks.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack(documents(spark, sf_dir).select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.scan(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x["item_id"].cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near occurrences that the operator of op8_decontaminate finds beside exact windows."""
    from . import decontaminate

    return decontaminate.proximity(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    found = license_scan.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.round("score", 6).alias("score"),
    )


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH t AS (SELECT doc_id, sha256({LOWERED}) AS h FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY h) AS keep_id,
       CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC) = 1 AS kept,
       h AS text_sha256
FROM t
"""

OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
),
e AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS raw FROM l),
s AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM e),
w AS (
  SELECT doc_id, pos AS start, lead(pos, 2) OVER o AS last, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c
  FROM s WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
v AS (
  SELECT doc_id, start, last, a, b, c FROM w WHERE c IS NOT NULL
  UNION ALL
  SELECT doc_id, min(pos), max(pos), arg_min(line, pos), chr(10) || count(*), arg_max(line, pos)
  FROM s WHERE line <> '' GROUP BY doc_id HAVING count(*) < 3
),
r AS (
  SELECT doc_id, start, last, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, start) AS nth FROM v
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, last + 1)) AS pos FROM r WHERE nth > 1),
island AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM gone),
span AS (SELECT doc_id, min(pos) AS a, max(pos) AS z FROM island GROUP BY doc_id, i),
spans AS (SELECT doc_id, string_agg(a || ':' || z, ',' ORDER BY a) AS removed, sum(z - a + 1) AS n FROM span GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS text
  FROM e ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (
  SELECT item_id, least(len(w), 13) AS n,
         array_to_string(list_slice(w, s + 1, s + 13), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM i WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
hit AS (SELECT DISTINCT doc_id, item_id, s, n FROM dw JOIN iw USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def _op10_sql() -> str:
    from .license_scan import BASE, COVER, DRIFT, TEMPLATES

    rows = [f"({i}, '{label}', '{text}', true)" for i, (text, label) in enumerate(BASE)]
    rows += [f"({len(BASE) + i}, '{label}', '{text}', false)" for i, (label, text) in enumerate(TEMPLATES)]
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t(template, label, text, base) AS (VALUES {", ".join(rows)}),
tg AS (
  SELECT template, label, base, len(tw) AS size, a, array_to_string(list_slice(tw, a + 1, a + 3), ' ') AS g
  FROM (SELECT template, label, base, tw, unnest(range(0, len(tw) - 2)) AS a
        FROM (SELECT *, string_split(text, ' ') AS tw FROM t))
),
dg AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p + 1, p + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS p FROM d WHERE len(w) > 2)
),
v AS (SELECT DISTINCT doc_id, template, label, base, size, a, p - a AS diag FROM dg JOIN tg USING (g)),
line AS (
  SELECT doc_id, template, label, base, size, diag, list(a) AS ats FROM v
  GROUP BY doc_id, template, label, base, size, diag HAVING NOT base OR count(*) = size - 2
),
f AS (
  SELECT *, CASE WHEN base OR lag(diag) OVER o IS NULL OR diag - lag(diag) OVER o > {DRIFT} THEN 1 ELSE 0 END AS fresh
  FROM line WINDOW o AS (PARTITION BY doc_id, template ORDER BY diag)
),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diag ROWS UNBOUNDED PRECEDING) AS run FROM f),
s AS (
  SELECT doc_id, label, base, min(diag + list_min(ats)) AS start, max(diag + list_max(ats)) + 2 AS last,
         list_distinct(flatten(list(ats))) AS ats, size
  FROM r GROUP BY doc_id, template, label, base, size, run
),
g AS (
  SELECT doc_id, label, base, start, last, len(ats) AS votes,
         len(list_distinct(flatten([ats, [x + 1 FOR x IN ats], [x + 2 FOR x IN ats]]))) / size AS share
  FROM s
),
w AS (SELECT * FROM g WHERE base OR share >= {COVER}),
b AS (
  SELECT * FROM w WHERE base OR NOT EXISTS (
    SELECT 1 FROM w AS x
    WHERE NOT x.base AND x.doc_id = w.doc_id AND x.votes > w.votes AND x.start <= w.last AND x.last >= w.start)
),
o AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM b GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CAST(coalesce(score, 0) AS DOUBLE), 6) AS score
FROM d LEFT JOIN o USING (doc_id)
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "benchmark_proximity": benchmark_proximity,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
}

ORACLES = {
    "op3_line_dedup": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_license_scan": _op10_sql(),
}
