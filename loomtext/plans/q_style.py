"""Queries over documents and labels: style statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import style as S
from ..sources.tables import read

MARKS = {"commas": ",", "stops": r"\.", "exclaims": "!", "questions": r"\?", "colons": ":", "semicolons": ";", "quotes": '"', "pipes": r"\|"}
FIGURES = {"shout": "[A-Z]{4,}!", "ellipsis": r"\.\.\.", "doubled": "!!", "simile": " as [a-z]+ as ", "listing": r" \| "}
POSITIVE, NEGATIVE = "aeiou", "xqzkj"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def sentence_stats(spark, d):
    return S.sentence_stats(documents(spark, d), ["lang"])


def sentence_types(spark, d):
    return S.sentence_types(documents(spark, d), ["lang"])


def connectors(spark, d):
    return S.connectors(documents(spark, d), ["lang"]).withColumn("rank", F.col("rank").cast("long"))


def para_class(spark, d):
    return S.paragraph_classes(documents(spark, d), ["lang"], long_chars=120, long_sentences=4, short_chars=60)


def sentiment_chars(spark, d):
    return documents(spark, d).select("doc_id", X.sentiment(F.col("text"), POSITIVE, NEGATIVE).alias("score"))


def sentiment_arc(spark, d):
    docs = documents(spark, d).select("source", F.explode(X.lines(F.col("text"))).alias("text"))
    return S.sentiment_arc(docs, ["source"], POSITIVE, NEGATIVE)


def rhetoric_counts(spark, d):
    out = S.rhetoric_totals(documents(spark, d).select("lang", "doc_id", "text"), ["lang"], FIGURES)
    return out.select("lang", "figure", "n", "per_doc", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


def parallel_heads(spark, d):
    return documents(spark, d).select("doc_id", X.parallel_heads(F.col("text")).alias("heads"))


def punct_profile(spark, d):
    return S.mark_counts(documents(spark, d), ["lang"], MARKS)


def style_profile(spark, d):
    return S.style_profile(documents(spark, d), ["source"])


def topk_words(spark, d):
    return S.top_words(documents(spark, d), ["lang"], 25).withColumn("rank", F.col("rank").cast("long"))


def ngram_freq(spark, d):
    return S.ngrams(documents(spark, d), ["lang"], 4, 50)


def gram_words(spark, d):
    return S.gram_words(documents(spark, d), ["lang"], (4, 3), 20)


def budget_sample(spark, d):
    rows = S.paragraph_rows(documents(spark, d), ["lang", "doc_id"]).withColumn("chars", F.length("line"))
    rows = rows.withColumn("kind", X.paragraph_class(F.col("line"), long_chars=120, long_sentences=4, short_chars=60))
    picked = S.budget_sample(rows, ["lang"], chars="chars", order=F.md5(F.concat_ws(":", "doc_id", "para")))
    return picked.select("lang", "doc_id", "para", "kind", F.col("chars").cast("long").alias("chars"))


def baseline_mean(spark, d):
    rows = documents(spark, d).join(read(spark, d, "labels"), "doc_id").select("lang", "text", F.col("quality").cast("string").alias("genre"))
    ledger = rows.select(
        "genre",
        F.explode(
            F.array(
                F.struct(F.lit("chars").alias("metric"), F.length("text").cast("double").alias("value")),
                F.struct(F.lit("lines").alias("metric"), F.size(X.lines(F.col("text"))).cast("double").alias("value")),
            )
        ).alias("m"),
    ).select("genre", "m.metric", "m.value")
    return S.baseline(ledger, "genre")


_SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '')"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"


def _clauses(text: str, least: int = 1) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '[.!?]'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: len(x) >= {least})"


_KIND = f"CASE WHEN len(line) >= 120 OR len({_clauses('line')}) >= 4 THEN 'long' WHEN len(line) <= 60 THEN 'short' ELSE 'mid' END"


def _chars(text: str) -> str:
    def hits(chars: str) -> str:
        return " + ".join(f"CAST(contains({text}, '{c}') AS INT)" for c in chars)

    p, n = hits(POSITIVE), hits(NEGATIVE)
    return f"round((({p}) - ({n})) / CAST(greatest(({p}) + ({n}), 1) AS DOUBLE), 3)"


def _connector_sql() -> str:
    parts = []
    for category, ws in X.LATIN.connectors.items():
        cases = " ".join(f"WHEN starts_with(lower(s), '{w}') THEN '{w}'" for w in ws)
        parts.append(f"SELECT lang, '{category}' AS category, CASE {cases} END AS word FROM s")
    return f"""
WITH s AS (SELECT lang, unnest({_SENT}) AS s FROM documents),
c AS ({" UNION ALL ".join(parts)}),
n AS (SELECT lang, category, word, count(*) AS n FROM c WHERE word IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, category, word) AS rank FROM n) WHERE rank <= 12
"""


def _cue_sql() -> str:
    return " OR ".join(f"contains(lower(s), '{c}')" for c in X.LATIN.rhetorical_cues)


QUERIES = {
    "q_sentence_stats": sentence_stats,
    "q_sentence_types": sentence_types,
    "q_connectors": connectors,
    "q_para_class": para_class,
    "q_sentiment_chars": sentiment_chars,
    "q_sentiment_arc": sentiment_arc,
    "q_rhetoric_counts": rhetoric_counts,
    "q_parallel_heads": parallel_heads,
    "q_punct_profile": punct_profile,
    "q_style_profile": style_profile,
    "q_topk_words_per_lang": topk_words,
    "q_ngram_freq": ngram_freq,
    "q_gram_words": gram_words,
    "q_budget_sample": budget_sample,
    "q_baseline_mean": baseline_mean,
}

ORACLES = {
    "q_sentence_stats": f"""
WITH s AS (SELECT lang, len(unnest({_SENT})) AS n FROM documents)
SELECT lang, count(*) AS n_sentences, round(sum(n) / count(*), 4) AS avg_len,
  count(*) FILTER (n <= 10) AS n_short, count(*) FILTER (n > 25) AS n_long,
  count(*) FILTER (n <= 10) AS len_1_10, count(*) FILTER (n > 10 AND n <= 20) AS len_11_20,
  count(*) FILTER (n > 20 AND n <= 30) AS len_21_30, count(*) FILTER (n > 30 AND n <= 40) AS len_31_40,
  count(*) FILTER (n > 40) AS len_41_up,
  round(count(*) FILTER (n <= 10) / count(*), 4) AS pct_short, round(count(*) FILTER (n > 25) / count(*), 4) AS pct_long
FROM s GROUP BY lang""",
    "q_sentence_types": f"""
WITH s AS (SELECT lang, unnest({_SENT}) AS s FROM documents)
SELECT lang, CASE WHEN right(s, 1) = '?' AND ({_cue_sql()}) THEN 'rhetorical' WHEN right(s, 1) = '?' THEN 'question'
  WHEN right(s, 1) = '!' THEN 'exclamation' ELSE 'statement' END AS kind, count(*) AS n FROM s GROUP BY ALL""",
    "q_connectors": _connector_sql(),
    "q_para_class": f"""
WITH p AS (SELECT lang, unnest({_LINES}) AS line FROM documents)
SELECT lang, {_KIND} AS kind, count(*) AS n, CAST(sum(len(line)) AS BIGINT) AS chars FROM p GROUP BY ALL""",
    "q_sentiment_chars": f"SELECT doc_id, {_chars('text')} AS score FROM documents",
    "q_sentiment_arc": f"""
WITH l AS (SELECT source, unnest({_LINES}) AS line FROM documents)
SELECT source, round(avg({_chars('line')}), 3) AS score, count(*) AS n FROM l GROUP BY source""",
    "q_rhetoric_counts": "WITH f AS ("
    + " UNION ALL ".join(f"SELECT lang, doc_id, '{k}' AS figure, len(regexp_extract_all(text, '{rx}')) AS n FROM documents" for k, rx in FIGURES.items())
    + """),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, figure ORDER BY doc_id) AS nth FROM f WHERE n > 0),
z AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
SELECT lang, figure, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / any_value(docs), 4) AS per_doc,
  string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (nth <= 3) AS examples
FROM r JOIN z USING (lang) GROUP BY lang, figure""",
    "q_parallel_heads": f"""
WITH h AS (SELECT doc_id, unnest(list_transform({_clauses('text', 6)}, lambda x: left(x, 2))) AS head FROM documents),
c AS (SELECT doc_id, head FROM h GROUP BY ALL HAVING count(*) >= 2),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN n >= 2 THEN n ELSE 0 END AS BIGINT) AS heads FROM documents LEFT JOIN n USING (doc_id)""",
    "q_punct_profile": "SELECT lang, "
    + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{rx}'))) AS BIGINT) AS {k}" for k, rx in MARKS.items())
    + ", CAST(sum(len(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "q_style_profile": f"""
WITH s AS (SELECT source, len(regexp_replace(unnest({_clauses('text')}), '[,;:"'' ]', '', 'g')) AS n FROM documents)
SELECT source, count(*) AS n, round(avg(n), 4) AS avg_len, round(count(*) FILTER (n < 15) / count(*), 4) AS short_share,
  round(count(*) FILTER (n > 40) / count(*), 4) AS long_share, count(*) FILTER (n < 10) AS bin_0,
  count(*) FILTER (n >= 10 AND n < 20) AS bin_10, count(*) FILTER (n >= 20 AND n < 30) AS bin_20,
  count(*) FILTER (n >= 30 AND n < 40) AS bin_30, count(*) FILTER (n >= 40 AND n < 60) AS bin_40, count(*) FILTER (n >= 60) AS bin_60
FROM s WHERE n > 0 GROUP BY source""",
    "q_topk_words_per_lang": r"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w WHERE len(word) >= 2 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 25""",
    "q_ngram_freq": r"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents),
g AS (SELECT lang, substr(w, i, 4) AS gram FROM (SELECT lang, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4))
SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 50""",
    "q_gram_words": r"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents),
g4 AS (SELECT lang, substr(w, i, 4) AS gram, count(*) AS n FROM (SELECT lang, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4) GROUP BY ALL HAVING count(*) >= 20),
g3 AS (SELECT lang, substr(w, i, 3) AS gram, count(*) AS n FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3) GROUP BY ALL HAVING count(*) >= 20),
p AS (SELECT lang, substr(gram, 1, 3) AS gram FROM g4 UNION SELECT lang, substr(gram, 2, 3) FROM g4)
SELECT * FROM g4 UNION ALL SELECT * FROM g3 ANTI JOIN p USING (lang, gram)""",
    "q_budget_sample": f"""
WITH l AS (SELECT lang, doc_id, {_LINES} AS ls FROM documents),
p AS (SELECT lang, doc_id, unnest(range(1, len(ls) + 1)) AS para, unnest(ls) AS line FROM l),
k AS (SELECT lang, doc_id, para, {_KIND} AS kind, len(line) AS chars FROM p),
z AS (SELECT lang, greatest(200.0, CAST(sum(chars) AS DOUBLE) * 0.1) AS target, CAST(coalesce(sum(chars) FILTER (kind = 'long'), 0) AS DOUBLE) AS l FROM k GROUP BY lang),
b AS (SELECT lang, target, greatest(0.0, target * 0.6 - l) AS lack FROM z),
r AS (SELECT *, sum(chars) OVER (PARTITION BY lang, kind ORDER BY md5(doc_id || ':' || para) ROWS UNBOUNDED PRECEDING) - chars AS before FROM k)
SELECT lang, doc_id, para, kind, chars FROM r JOIN b USING (lang)
WHERE before < CASE kind WHEN 'long' THEN target * 0.6 WHEN 'mid' THEN target * 0.25 + lack * 0.25 / 0.4 ELSE target * 0.15 + lack * 0.15 / 0.4 END""",
    "q_baseline_mean": f"""
WITH r AS (SELECT CAST(quality AS VARCHAR) AS genre, text FROM documents JOIN labels USING (doc_id)),
m AS (SELECT genre, 'chars' AS metric, CAST(len(text) AS DOUBLE) AS value FROM r UNION ALL SELECT genre, 'lines', CAST(len({_LINES}) AS DOUBLE) FROM r)
SELECT metric, genre, round(avg(value), 4) AS mean, count(*) AS n_books FROM m GROUP BY ALL
UNION ALL SELECT metric, 'all', round(avg(value), 4), count(*) FROM m GROUP BY metric""",
}
