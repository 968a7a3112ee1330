"""Line dedup over windows of three consecutive lines.

Lines are compared without white space at their ends; blank lines are passed over when
windows are formed. Every window of three such lines is hashed to 128 bits; a text with
only one or two of them is one window of all. Windows that occur more than once anywhere
are repeated; the first occurrence, by (doc_id, row, line), stays, and every later one
marks its lines, blank ones between them included. Marked lines merge into spans, which
are removed. Windows overlap, so a repeated passage of any length over two lines goes as a
whole, and the text that stays always holds an earlier copy of what went.

Rows are numbered in a written table, and all that follows goes by that number. The
windows are written once as narrow rows. Counting them uses map-side partial aggregation,
so a line that a third of all documents share is a few rows in the shuffle; later
occurrences come from an equi-join with the repeated hashes, which adaptive execution
splits where skewed. Only documents with marks need their text changed.

Defined results: null text stays null with no lines; a text without lines that are not
blank has no windows and stays as it is. Rows that repeat a doc_id, or have none, are
documents of their own: the one that comes first in the table is the earlier. A null
doc_id comes before all others. Other columns are not looked at, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, numbered, scope, shifted

_WHITE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(held: DataFrame) -> DataFrame:
    """(id, row, start, last, h, g): the windows with their first and last line, 128 bits. held: (id, row, text)."""
    trimmed = F.transform(_lines(F.col("text")), lambda line, i: F.struct(F.btrim(line, F.lit(_WHITE)).alias("line"), i.alias("at")))
    some = held.select("id", "row", F.filter(trimmed, lambda x: x["line"] != "").alias("s"))
    # of fewer than three lines, the first and the last, which may be the same, with nothing between
    few = F.array(F.struct(F.get("s", F.lit(0)).alias("a"), F.lit(None).cast("struct<line:string,at:int>").alias("b"), F.element_at("s", -1).alias("c")))
    three = F.arrays_zip(F.col("s").alias("a"), shifted(F.col("s"), 1).alias("b"), shifted(F.col("s"), 2).alias("c"))
    all_of = F.when(F.size("s") < 3, few.cast("array<struct<a:struct<line:string,at:int>,b:struct<line:string,at:int>,c:struct<line:string,at:int>>>")).otherwise(three)
    rows = some.where("size(s) > 0").select("id", "row", F.explode(all_of).alias("w")).where("w.c IS NOT NULL")
    between = F.coalesce("w.b.line", F.concat(F.lit("\n"), (F.col("w.a.at") == F.col("w.c.at")).cast("string")))  # no line holds a line feed
    return rows.select(
        "id",
        "row",
        F.col("w.a.at").alias("start"),
        F.col("w.c.at").alias("last"),
        F.xxhash64("w.a.line", between, "w.c.line").alias("h"),
        F.xxhash64(F.lit(1), "w.c.line", between, "w.a.line").alias("g"),
    )


def removed_spans(held: DataFrame) -> DataFrame:
    """(row, spans): sorted structs (start, last) of lines to remove, both included. held: (id, row, text)."""
    rows = materialize(windows(held), "line-windows")
    repeated = materialize(
        rows.groupBy("h", "g")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "start")).alias("first"))
        .where("n > 1")
        .select(F.col("h").alias("rh"), F.col("g").alias("rg"), F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")),
        "line-repeats",
    )
    later = (
        rows.join(repeated, (F.col("h") == F.col("rh")) & (F.col("g") == F.col("rg")))
        .where("row <> first_row OR start <> first_start")
        .select("row", "start", "last")
    )
    by_doc = W.partitionBy("row").orderBy("start", "last")
    before = F.max("last").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    runs = later.withColumn("fresh", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    return (
        runs.groupBy("row", "run")
        .agg(F.min("start").alias("start"), F.max("last").alias("last"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "last"))).alias("spans"))
    )


def _without(text: Column, spans: Column) -> Column:
    """The text without the lines of the spans: the stretches between them, joined."""
    lines = _lines(text)
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(lines)))
    froms = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["last"] + 1))
    stretches = F.zip_with(froms, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))
    return F.array_join(F.flatten(stretches), "\n")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, spans) per document, text without removed lines."""
    held = numbered(docs.select("doc_id", "text"), "line-rows").select(F.col("c0").alias("id"), "row", F.col("c1").alias("text"))
    with scope(docs.sparkSession):
        spans = materialize(removed_spans(held), "line-spans", outer=True)
    both = held.join(spans, "row", "left")
    gone = F.aggregate(F.col("spans"), F.lit(0), lambda n, s: n + s["last"] - s["start"] + 1)
    return both.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("spans"))).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"),
    )
