"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

build_index() stores postings (term, doc, pos) of the training documents for the terms
that the test items use, plus one length posting per document (term 0 at position
n_words), as Parquet segments in the shared folder: documents are tokenised once, and
every later step reads three narrow columns of the segments. Postings are not shuffled.

A search intersects offset-adjusted lists from the rarest terms on:

1. Document frequencies of the test terms come from the index, over all documents.
2. Every window of `window` consecutive item words picks its two rarest words as
   anchors. Windows with a word that no document has are dropped.
3. Postings of the anchors, less their offset in the item, are diagonals (doc, item,
   delta). A diagonal is a candidate if both anchors of some window lie on it.
4. Candidates are verified word by word against the document; runs of at least
   `window` equal words are exact occurrences of windows, and their words are hit.

Windows are grouped by diagonal, so a passage of any length is one candidate and not
one for each window. The test vocabulary is broadcast only while its counted size is
under `BROADCAST_TERMS`; beyond that the join shuffles. Documents are numbered in a
written table, and postings carry that number, so that hits go to the row that they stand
in, whatever doc_ids repeat or are null. Only the matched diagonals are joined back to the
texts, with an equi-join on the number.

proximity() finds near occurrences by the same index: the two rarest words of a window
that any document has stand in the window's order in a document, their diagonals at most
`SLACK` words apart, and the document's words around them, as many as the window's and
`SLACK` more on either side, hold at least `SHARE` of the window's distinct words. So it
finds a passage with words put in, left out or changed, which exact windows miss; an exact
occurrence is a near one. The two lists meet by blocks of diagonals, so each posting meets
only those that may be near. A window with fewer than two words that documents have has no
near occurrence.

proximity_match() uses the same postings for two given words within a distance, in any order.

Defined results: words are runs of ASCII digits and letters and of all non-ASCII
characters, A-Z lower-cased; null has none. An item of fewer words than the window,
but not none, is one window. Equal item texts and repeated (doc_id, text) rows each get
their result; a document without words is clean. Items that repeat an item_id count
once. Null ids are ids like any other. Other columns are not looked at, whatever their
names; an empty table of documents gives an empty result, one of items no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, materialize, numbered, renamed, scope

WINDOW = 13
SLACK = 6
SHARE = 0.8
BROADCAST_TERMS = 200_000
_LENGTH = 0  # the term id of length postings


def item_words(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(item, words) of the items that have words; item numbers distinct (id, words)."""
    rows = items.select(F.col(id_col).alias("item_id"), ascii_words(F.col("text")).alias("words")).where("size(words) > 0")
    return rows.distinct().withColumn("item", F.xxhash64("item_id", "words"))


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, term): the distinct words of the items."""
    return items.select(F.explode("words").alias("word")).distinct().withColumn("term", F.xxhash64("word"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, *, max_broadcast: int = BROADCAST_TERMS) -> DataFrame:
    """Postings (term, row, pos) of the terms, or of all words, and the length postings.

    docs: (row, text); terms: (word, term). Written to the shared folder, sorted by term within segments.
    """
    # the empty word cannot occur in a text: it marks the end, and so the length
    words = F.concat(ascii_words(F.col("text")), F.array(F.lit("")))
    posts = docs.select("row", F.posexplode(words).alias("pos", "word"))
    if terms is None:
        posts = posts.withColumn("term", F.when(F.col("word") == "", F.lit(_LENGTH)).otherwise(F.xxhash64("word")))
    else:
        end = terms.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(_LENGTH).cast("long").alias("term"))
        terms = terms.select("word", "term").unionByName(end)
        if terms.count() <= max_broadcast:
            terms = F.broadcast(terms)
        posts = posts.join(terms, "word")
    return materialize(posts.select("term", "row", "pos").sortWithinPartitions("term"), "postings")


def anchors(items: DataFrame, index: DataFrame, window: int = WINDOW, *, whole: bool = True) -> DataFrame:
    """(item, window, term, offset): for each window its two rarest positions.

    whole drops windows with a word that no document has; else such words are passed over.
    Document counts meet each item position once; the windows are slices of the item.
    The counts have as many rows as the items have distinct words, so they are broadcast
    while the items are small.
    """
    counts = index.where(F.col("term") != _LENGTH).groupBy("term").agg(F.count("*").alias("df"))
    if (items.agg(F.sum(F.size("words"))).first()[0] or 0) <= BROADCAST_TERMS:
        counts = F.broadcast(counts)
    words = items.select("item", F.posexplode("words").alias("offset", "word")).withColumn("term", F.xxhash64("word"))
    rows = words.join(counts, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("offset", "term", "df"))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    slices = rows.select("item", F.explode(starts).alias("window"), "w").select("item", "window", F.slice("w", F.col("window") + 1, window).alias("s"))
    met = slices.where(~F.exists("s", lambda x: x["df"].isNull())) if whole else slices
    had = F.filter("s", lambda x: x["df"].isNotNull())
    rarest = F.slice(F.array_sort(F.transform(had, lambda x: F.struct(x["df"], x["offset"], x["term"]))), 1, 2)
    return met.select("item", "window", F.explode(rarest).alias("r")).select("item", "window", "r.term", "r.offset")


def candidates(items: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """Diagonals (row, item, delta, size) on which all anchors of some window lie."""
    chosen = materialize(anchors(items, index, window), "anchors")
    need = chosen.groupBy("item", "window").agg(F.sort_array(F.collect_set("offset")).alias("need"))
    need = need.groupBy("item").agg(F.collect_set("need").alias("needs"))
    need = need.join(items.select("item", F.size("words").alias("size")), "item")
    points = chosen.select("item", "term", "offset").distinct()
    if chosen.count() <= BROADCAST_TERMS:  # the postings then meet them where they are read
        points = F.broadcast(points)
    met = (
        index.join(points, "term")
        .select("row", "item", (F.col("pos") - F.col("offset")).alias("delta"), "offset")
        .groupBy("row", "item", "delta")
        .agg(F.collect_set("offset").alias("met"))  # at most as many as the item has words
    )
    all_met = F.exists("needs", lambda need: F.size(F.array_except(need, "met")) == 0)
    return met.join(need, "item").where(all_met).select("row", "item", "delta", "size")


def _in_windows(same: Column, window: Column) -> Column:
    """Positions of an array of booleans that lie in `window` trues in a row."""
    last = F.size(same) - window
    starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i <= last) & F.forall(F.slice(same, i + 1, window), lambda x: x))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + window - 1))))


def matches(docs: DataFrame, items: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item_id, pos): document words inside an occurrence of a window of the item. docs: (row, text)."""
    found = candidates(items, index, window)
    per_doc = found.groupBy("row").agg(F.collect_list(F.struct("item", "delta", "size")).alias("found"))
    texts = docs.select("row", "text").join(per_doc, "row").select("row", ascii_words(F.col("text")).alias("has"), "found")

    def beside(f: Column) -> Column:  # the words beside the item; only they travel on
        at, skip = F.greatest(f["delta"], F.lit(0)), F.greatest(-f["delta"], F.lit(0))
        return F.struct(f["item"].alias("item"), at.alias("at"), skip.alias("skip"), F.slice("has", at + 1, f["size"] - skip).alias("has"))

    lined = (
        texts.select("row", F.explode(F.transform("found", beside)).alias("f"))
        .select("row", "f.*")
        .join(items.select("item", "item_id", "words"), "item")
        .withColumn("words", F.expr("slice(words, skip + 1, size(words))"))
    )
    same = F.transform(F.arrays_zip(F.col("has").alias("a"), F.col("words").alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    # an item shorter than the window is one window of its own length
    least = F.least(F.size("words") + F.col("skip"), F.lit(window))
    return (
        lined.select("row", "item_id", "at", F.explode(_in_windows(same, least)).alias("k"))
        .select("row", "item_id", (F.col("at") + F.col("k")).cast("long").alias("pos"))
        .distinct()
    )


def _found(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(row, n_words, n_hit, items) of every document (row, text)."""
    words = materialize(item_words(items), "items")
    index = build_index(docs, vocabulary(words))
    hit = matches(docs, words, index, window)
    per_doc = (
        hit.groupBy("row", "pos")
        .agg(F.collect_set(F.struct("item_id")).alias("ids"))
        .groupBy("row")
        .agg(F.count("*").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    )
    lengths = index.where(F.col("term") == _LENGTH).select("row", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast(per_doc.schema["ids"].dataType)
    return lengths.join(per_doc, "row", "left").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", none).alias("items")
    )


def scan(docs: DataFrame, items: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit and the sorted array of its item_ids."""
    held = numbered(docs.select("doc_id", "text"), "decontaminate-rows")
    with scope(docs.sparkSession):
        found = materialize(_found(held.select("row", F.col("c1").alias("text")), items, window), "decontaminate-found", outer=True)
    return held.select("row", F.col("c0").alias("doc_id")).join(found, "row").drop("row")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A document is contaminated if at least a twentieth of its words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def keep_clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated; all columns stay."""
    held = numbered(docs, "decontaminate-rows")
    text = F.col(f"c{docs.columns.index('text')}").alias("text")
    with scope(docs.sparkSession):
        bad = _found(held.select("row", text), items, window).where(contaminated(F.col("n_hit"), F.col("n_words"))).select("row")
        bad = materialize(bad, "decontaminate-bad", outer=True)
    return renamed(held.join(bad, "row", "left_anti"), docs.columns)


def near_places(items: DataFrame, index: DataFrame, *, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(row, item, window, size, start): where the first anchor puts a window, with the second one near enough.

    start is the place of the window's first word, which may lie before the text; size is
    the number of the window's words.
    """
    two = anchors(items, index, window, whole=False).groupBy("item", "window").agg(F.array_sort(F.collect_list(F.struct("offset", "term"))).alias("r"))
    size = F.least(F.size("words"), F.lit(window)).alias("size")
    two = materialize(two.where("size(r) = 2").join(items.select("item", size), "item"), "near-anchors")
    few = two.count() <= BROADCAST_TERMS

    def placed(k: int, start: str, pos: str) -> DataFrame:
        asked = two.select("item", "window", "size", F.col("r")[k]["term"].alias("term"), (F.col("r")[k]["offset"] - F.col("window")).alias("by"))
        met = index.join(F.broadcast(asked) if few else asked, "term")
        return met.select("row", "item", "window", "size", F.col("pos").alias(pos), (F.col("pos") - F.col("by")).alias(start))

    block = lambda start: F.floor(F.col(start) / F.lit(slack + 1))
    first = placed(0, "start", "a").withColumn("k", block("start"))
    second = placed(1, "other", "b").withColumn("k", block("other"))
    second = second.select("row", "item", "window", "other", "b", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    near = first.join(second, ["row", "item", "window", "k"]).where((F.abs(F.col("start") - F.col("other")) <= slack) & (F.col("a") < F.col("b")))
    return near.select("row", "item", "window", "size", "start").distinct()


def proximity(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """One row per document and item that it nearly holds: doc_id, item_id, n_places, share.

    n_places counts the window's near occurrences by their first word; share is the largest
    part of a window's distinct words that one of them has. A row that repeats a doc_id has
    rows of its own.
    """
    held = numbered(docs.select("doc_id", "text"), "proximity-rows")
    with scope(docs.sparkSession):
        words = materialize(item_words(items), "items")
        texts = held.select("row", F.col("c1").alias("text"))
        found = near_places(words, build_index(texts, vocabulary(words)), window=window, slack=slack)
        per_doc = found.groupBy("row").agg(F.collect_list(F.struct("item", "window", "size", "start")).alias("found"))

        def around(f: Column) -> Column:  # only these words of the text travel on
            at = F.greatest(f["start"] - slack, F.lit(0))
            return F.struct(f["item"].alias("item"), f["window"].alias("window"), f["size"].alias("size"), F.slice("has", at + 1, f["start"] + f["size"] + slack - at).alias("has"))

        split = texts.join(per_doc, "row").select("row", ascii_words(F.col("text")).alias("has"), "found")
        placed = split.select("row", F.explode(F.transform("found", around)).alias("f")).select("row", "f.*")
        wanted = F.array_distinct(F.slice("words", F.col("window") + 1, F.col("size")))
        shares = placed.join(words, "item").select("row", "item_id", (F.size(F.array_intersect(wanted, "has")) / F.size(wanted)).alias("share"))
        best = shares.where(F.col("share") >= share).groupBy("row", "item_id").agg(F.count("*").alias("n_places"), F.max("share").alias("share"))
        best = materialize(best, "proximity-found", outer=True)
    return held.select("row", F.col("c0").alias("doc_id")).join(best, "row").drop("row")


def proximity_match(index: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """(row, a, b): positions of two words at most `distance` apart, in any order.

    Postings are joined on the document and on blocks of `distance` positions, so a
    pair is met only where it may be near.
    """
    block = F.floor(F.col("pos") / F.lit(max(distance, 1)))
    a = index.where(F.col("term") == F.xxhash64(F.lit(first))).select("row", F.col("pos").alias("a"), block.alias("k"))
    b = index.where(F.col("term") == F.xxhash64(F.lit(second))).select("row", F.col("pos").alias("b"), block.alias("k"))
    b = b.select("row", "b", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    return a.join(b, ["row", "k"]).where((F.abs(F.col("a") - F.col("b")) <= distance) & (F.col("a") != F.col("b"))).select("row", "a", "b")
