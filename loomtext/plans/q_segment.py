"""Queries over documents, conversations, embeddings and pages: readers and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, segment
from ..operators.style import paragraph_rows
from ..sources import novel
from ..sources.tables import read

HEADING = "^(The|Der|La|Le|Th|En|Er) "
VOLUME = "^(This|Released|Licensed) "


def _lines(spark, d):
    books = read(spark, d, "documents").select(F.col("doc_id").alias("book"), "text")
    return novel.numbered_lines(books, volume=VOLUME, chapter=HEADING)


def paragraphs(spark, d):
    p = novel.paragraphs(_lines(spark, d))
    return p.select("book", "para_id", "volume_no", "chapter_no", F.length("text").cast("long").alias("chars"))


def chapters(spark, d):
    lines = _lines(spark, d)
    return novel.chapters(lines, novel.paragraphs(lines))


def coverage_audit(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    labels = read(spark, d, "labels").select("doc_id")
    return audit.uncovered(docs, ["doc_id"], labels, docs.where("doc_id % 3 = 0"))


def xhtml_text(spark, d):
    text = novel.xhtml_to_text(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.length(text).cast("long").alias("chars"), F.size(X.lines(text)).cast("long").alias("n_lines"))


def _paras(spark, d):
    return paragraph_rows(read(spark, d, "documents"), ["doc_id"]).withColumnRenamed("line", "text")


def dialogue_breaks(spark, d):
    rows = segment.rule_breaks(_paras(spark, d), ["doc_id"], "para", F.length("text") < 100, ["This ", "Released "])
    return rows.select("doc_id", "para", "brk", F.col("block").cast("long").alias("block"))


def scene_pack(spark, d):
    rows = segment.rule_breaks(_paras(spark, d), ["doc_id"], "para", F.length("text") < 100, ["This ", "Released "], run=2)
    return segment.pack_scenes(rows.withColumn("switch", F.col("text").startswith("This ")), ["doc_id"], "para", switch="switch")


def adjacent_cosine_breaks(spark, d):
    rows = segment.cosine_breaks(read(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.1)
    return rows.select("vec_id", "label", F.round("sim", 6).alias("sim"), "brk")


def prev_tail(spark, d):
    rows = segment.previous_tail(read(spark, d, "conversations"), ["conv_id"], ["turn"])
    return rows.select("conv_id", "turn", "prev_tail")


def location_cuts(spark, d):
    from ..operators.style import place_cuts

    rows = read(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("where"))
    return place_cuts(rows, ["conv_id"], ["turn"])


def chunk_batch(spark, d):
    return segment.batches(read(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 3)


def greedy_chunks(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return segment.chunk_by_budget(rows, ["conv_id"], "turn", "chars", max_rows=4, max_size=800)


def range_join(spark, d):
    paras = _paras(spark, d).select("doc_id", "para", F.length("text").cast("long").alias("chars"))
    sizes = paras.groupBy("doc_id").agg(F.max("para").alias("n"))
    starts = sizes.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(5).cast("long"))).alias("start"))
    scenes = starts.select("doc_id", "start", (F.col("start") + 4).alias("end"), (F.floor((F.col("start") - 1) / 5) + 1).alias("event_seq"))
    return segment.rows_in_scenes(paras, scenes, ["doc_id"], "para").groupBy("doc_id", "event_seq").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))


def raw_text(spark, d):
    out = segment.raw_texts(read(spark, d, "conversations"), ["conv_id"], "turn")
    return out.select("conv_id", F.md5(F.col("raw_text")).alias("digest"), F.length("raw_text").cast("long").alias("chars"))


_ROWS = r"""
l AS (SELECT doc_id AS book, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || '　' || chr(65279))) AS ls FROM documents),
e AS (SELECT book, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM l),
f AS (SELECT *, regexp_matches(line, '%s') AS v, regexp_matches(line, '%s') AND NOT regexp_matches(line, '%s') AS c FROM e WHERE line <> ''),
n AS (SELECT *, CAST(sum(CAST(v AS INT)) OVER w AS BIGINT) AS volume_no, CAST(sum(CAST(c AS INT)) OVER w AS BIGINT) AS chapter_no
      FROM f WINDOW w AS (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) AS para_id, volume_no, chapter_no, line FROM n WHERE NOT v AND NOT c)
""" % (VOLUME, HEADING, VOLUME)
_PARAS = r"""
p AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS para, unnest(ls) AS line FROM
  (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ls FROM documents))
"""
_BODY = r"coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html)"
_XHTML = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)</?(p|h[1-6]|div|li|br|tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '^[<>\s]+', '')"
_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

QUERIES = {
    "q_paragraphs": paragraphs,
    "q_chapters": chapters,
    "q_coverage_audit": coverage_audit,
    "q_xhtml_text": xhtml_text,
    "q_dialogue_breaks": dialogue_breaks,
    "q_scene_pack": scene_pack,
    "q_adjacent_cosine_breaks": adjacent_cosine_breaks,
    "q_prev_tail": prev_tail,
    "q_location_cuts": location_cuts,
    "q_chunk_batch": chunk_batch,
    "q_greedy_chunks": greedy_chunks,
    "q_range_join": range_join,
    "q_raw_text": raw_text,
}

ORACLES = {
    "q_paragraphs": f"WITH {_ROWS} SELECT book, para_id, volume_no, chapter_no, len(line) AS chars FROM p",
    "q_chapters": f"""WITH {_ROWS},
t AS (SELECT book, chapter_no, volume_no, line AS title FROM n WHERE c),
s AS (SELECT book, chapter_no, min(para_id) AS start_para, max(para_id) AS end_para FROM p WHERE chapter_no > 0 GROUP BY ALL)
SELECT book, chapter_no, volume_no, title, start_para, end_para FROM t LEFT JOIN s USING (book, chapter_no)""",
    "q_coverage_audit": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 3 <> 0",
    "q_xhtml_text": f"""WITH t AS (SELECT page_id, {_XHTML} AS t FROM pages)
SELECT page_id, len(t) AS chars, len(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')) AS n_lines FROM t""",
    "q_dialogue_breaks": f"""WITH {_PARAS},
m AS (SELECT *, len(line) < 100 AS dlg FROM p),
b AS (SELECT doc_id, para, (coalesce(NOT dlg AND lag(dlg) OVER w AND lag(dlg, 2) OVER w AND lag(dlg, 3) OVER w, false)
        OR starts_with(line, 'This ') OR starts_with(line, 'Released ')) AND para > 1 AS brk FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY para))
SELECT doc_id, para, brk, CAST(sum(CAST(brk AS INT)) OVER (PARTITION BY doc_id ORDER BY para ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM b""",
    "q_adjacent_cosine_breaks": f"""
WITH v AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
s AS (SELECT vec_id, label, CASE WHEN p IS NOT NULL THEN {_COS.format(a="p", b="e")} / sqrt({_COS.format(a="e", b="e")}) / sqrt({_COS.format(a="p", b="p")}) END AS sim FROM v)
SELECT vec_id, label, round(sim, 6) AS sim, coalesce(sim < 0.1, false) AS brk FROM s""",
    "q_prev_tail": """SELECT conv_id, turn, coalesce(string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), chr(10))[-1], '') AS prev_tail FROM conversations""",
    "q_location_cuts": """WITH l AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, CAST(sum(CASE WHEN p <> role AND p <> '' AND role <> '' THEN 1 ELSE 0 END) AS BIGINT) AS cuts, count(*) AS scenes FROM l GROUP BY conv_id""",
    "q_chunk_batch": "SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS batch FROM conversations",
    "q_range_join": f"""WITH {_PARAS} SELECT doc_id, (para - 1) // 5 + 1 AS event_seq, CAST(sum(len(line)) AS BIGINT) AS chars, count(*) AS n FROM p GROUP BY ALL""",
    "q_raw_text": "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, len(string_agg(text, chr(10) ORDER BY turn)) AS chars FROM conversations GROUP BY conv_id",
}
