"""Readers of long-form texts: plain text in several encodings, EPUB, XHTML."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: heading lines of Chinese novels, fixed by the data format
VOLUME = "^第[一二三四五六七八九十百千0-9]+卷"
CHAPTER = "^第[一二三四五六七八九十百千0-9]+章"
ENCODINGS = ("utf-8", "gb18030", "gbk")


def decode_bytes(raw: bytes | None) -> str:
    """The first strict decoding that fits, else UTF-8 without what does not."""
    raw = raw or b""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore")


def decoded(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(raws: pd.Series) -> pd.Series:
        return raws.map(decode_bytes)

    return run(content)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(book, text) of text files, decoded."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("book"), decoded(F.col("content")).alias("text"))


def xhtml_to_text(page: Column) -> Column:
    """The body of a page as lines: a line break around blocks, tags stripped, entities resolved."""
    body = F.coalesce(F.nullif(F.regexp_extract(page, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), page)
    body = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    broken = F.regexp_replace(body, r"(?i)</?(p|h[1-6]|div|li|br|tr)\b[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(broken, r"<[^>]*>", ""), r"^[<>\s]+", "")


def unescaped(text: Column) -> Column:
    """HTML entities resolved."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return run(text)


def numbered_lines(books: DataFrame, *, volume: str = VOLUME, chapter: str = CHAPTER, max_chapters: int | None = None) -> DataFrame:
    """(book, pos, line, volume_no, chapter_no, heading) of the non-blank lines of (book, text).

    Headings bump dense counters and are marked; lines before the first chapter have
    chapter 0; reading stops where chapter max_chapters + 1 begins. Counters run within a
    book, so books are independent and spread over the cluster.
    """
    parts = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r　﻿")))
    rows = books.select("book", F.posexplode(parts).alias("pos", "line")).where("line <> ''")
    is_volume = F.col("line").rlike(volume)
    is_chapter = F.col("line").rlike(chapter) & ~is_volume
    so_far = W.partitionBy("book").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("heading", F.when(is_volume, "volume").when(is_chapter, "chapter")).select(
        "book",
        "pos",
        "line",
        F.sum(is_volume.cast("int")).over(so_far).alias("volume_no"),
        F.sum(is_chapter.cast("int")).over(so_far).alias("chapter_no"),
        "heading",
    )
    return out if max_chapters is None else out.where(F.col("chapter_no") <= max_chapters)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(book, para_id, volume_no, chapter_no, text): a dense para_id over lines that are no headings."""
    order = W.partitionBy("book").orderBy("pos")
    rows = lines.where("heading IS NULL")
    return rows.select("book", F.row_number().over(order).cast("long").alias("para_id"), "volume_no", "chapter_no", F.col("line").alias("text"))


def chapters(lines: DataFrame, paras: DataFrame) -> DataFrame:
    """(book, chapter_no, volume_no, title, start_para, end_para)."""
    titles = lines.where("heading = 'chapter'").select("book", "chapter_no", "volume_no", F.col("line").alias("title"))
    spans = paras.where("chapter_no > 0").groupBy("book", "chapter_no").agg(F.min("para_id").alias("start_para"), F.max("para_id").alias("end_para"))
    return titles.join(spans, ["book", "chapter_no"], "left")


def preamble(paras: DataFrame) -> DataFrame:
    return paras.where("chapter_no = 0")


def epub_lines(raw: bytes, chapter: str = CHAPTER) -> Iterator[tuple[int, int, str]]:
    """(spine position, line position, line) of an EPUB, in spine order.

    Members are chapter_* items under OEBPS; missing ones are passed over. In a member
    text before the first heading is dropped; a member without one continues the
    chapter before it.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        package = next((n for n in book.namelist() if n.endswith(".opf")), None)
        if package is None:
            return
        opf = decode_bytes(book.read(package))
        refs = re.findall(r'<itemref[^>]*\bidref="([^"]+)"', opf) or re.findall(r"<itemref[^>]*\bidref='([^']+)'", opf)
        for at, ref in enumerate(r for r in refs if r.startswith("chapter_")):
            member = f"OEBPS/{ref}"
            if member not in names:
                continue
            page = decode_bytes(book.read(member))
            found = re.search(r"(?is)<body[^>]*>(.*)</body>", page)
            text = re.sub(r"(?i)</?(p|h[1-6]|div|li|br)\b[^>]*>", "\n", found[1] if found else page)
            text = html.unescape(re.sub(r"<[^>]*>", "", text))
            lines = [x.strip() for x in text.split("\n") if x.strip()]
            first = next((i for i, x in enumerate(lines) if re.match(chapter, x)), 0)
            for i, line in enumerate(lines[first:]):
                yield at, i, line


def read_epubs(spark: SparkSession, path: str, chapter: str = CHAPTER) -> DataFrame:
    """(book, text) of EPUB files: their lines joined, ready for numbered_lines()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = ["\n".join(line for _, _, line in epub_lines(bytes(raw), chapter)) for raw in pdf["content"]]
            yield pd.DataFrame({"book": pdf["path"], "text": texts})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "book string, text string")


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """(book, text) by the ending of the path: .epub, or text."""
    return read_epubs(spark, path) if path.lower().endswith(".epub") else read_texts(spark, path)


def identify(books: DataFrame, default: int = 50, pattern: str = "第[一二三四五六七八九十百千0-9]+章") -> DataFrame:
    """(book, name, format, chapters): chapters counts all headings, default where there are none."""
    name = F.regexp_extract("book", r"([^/\\]+?)(?:\.[^.]*)?$", 1)
    kind = F.when(F.lower("book").endswith(".epub"), "epub").otherwise("txt")
    n = F.regexp_count("text", F.lit(pattern))
    return books.select("book", name.alias("name"), kind.alias("format"), F.when(n == 0, default).otherwise(n).cast("long").alias("chapters"))
