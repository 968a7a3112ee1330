"""Style statistics: sentences, words, punctuation, rhetoric, samples and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: parts that the rows of a key are dealt into where keys are few
SHARES = 1024


def sentence_rows(docs: DataFrame, keys: Sequence[str], profile: X.Profile = X.LATIN, text: str = "text") -> DataFrame:
    """One row per sentence: keys, pos, sentence, n (characters, the mark counted)."""
    return docs.select(*keys, F.posexplode(X.sentences(F.col(text), profile)).alias("pos", "sentence")).withColumn("n", F.length("sentence"))


def sentence_stats(docs: DataFrame, keys: Sequence[str], profile: X.Profile = X.LATIN, *, short: int = 10, long: int = 25, edges=(10, 20, 30, 40)) -> DataFrame:
    """Counts, mean length, shares and buckets of sentences per key."""
    rows = sentence_rows(docs, keys, profile)
    n = F.col("n")
    bounds = [(0, edges[0]), *zip(edges, edges[1:]), (edges[-1], None)]
    buckets = [
        F.count_if((n > lo) & (n <= hi) if hi is not None else n > lo).alias(f"len_{lo + 1}_{hi if hi is not None else 'up'}") for lo, hi in bounds
    ]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_sentences"),
        F.round(F.sum("n") / F.count("*"), 4).alias("avg_len"),
        F.count_if(n <= short).alias("n_short"),
        F.count_if(n > long).alias("n_long"),
        *buckets,
    )
    return out.withColumn("pct_short", X.share(F.col("n_short"), F.col("n_sentences"), 4)).withColumn("pct_long", X.share(F.col("n_long"), F.col("n_sentences"), 4))


def sentence_types(docs: DataFrame, keys: Sequence[str], profile: X.Profile = X.LATIN) -> DataFrame:
    rows = sentence_rows(docs, keys, profile).withColumn("kind", X.sentence_type(F.col("sentence"), profile))
    return rows.groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def connectors(docs: DataFrame, keys: Sequence[str], profile: X.Profile = X.LATIN, top: int = 12) -> DataFrame:
    """The most frequent sentence openers per key; at most one word of each category a sentence."""
    rows = sentence_rows(docs, keys, profile)
    found = F.array(*[F.struct(F.lit(c).alias("category"), X.connector(F.col("sentence"), words).alias("word")) for c, words in profile.connectors.items()])
    counted = rows.select(*keys, F.explode(F.filter(found, lambda x: x["word"].isNotNull())).alias("c")).groupBy(*keys, "c.category", "c.word").agg(F.count("*").alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), "category", "word")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*keys, "category", "word", "n", "rank")


def paragraph_rows(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per non-blank line: keys, para (from 1), line."""
    return docs.select(*keys, F.posexplode(X.lines(F.col(text))).alias("pos", "line")).select(*keys, (F.col("pos") + 1).cast("long").alias("para"), "line")


def paragraph_classes(docs: DataFrame, keys: Sequence[str], **limits) -> DataFrame:
    rows = paragraph_rows(docs, keys).withColumn("kind", X.paragraph_class(F.col("line"), **limits))
    return rows.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def words(text: Column, min_length: int = 2) -> Column:
    """Lower-cased runs of letters of at least min_length characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.filter(found, lambda w: F.length(w) >= min_length)


def top_words(docs: DataFrame, keys: Sequence[str], k: int = 25, *, min_length: int = 2, stop: DataFrame | None = None) -> DataFrame:
    """The k most frequent words per key, without stop words (a table with the column word)."""
    rows = docs.select(*keys, F.explode(words(F.col("text"), min_length)).alias("word"))
    counted = rows.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    if stop is not None:
        counted = counted.join(stop.select("word"), "word", "left_anti")
    return counted.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)


def ngrams(docs: DataFrame, keys: Sequence[str], size: int, min_count: int = 5) -> DataFrame:
    """Character n-grams inside runs of letters that occur at least min_count times per key.

    The fallback tokeniser for scripts without spaces.
    """
    runs = docs.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("run")).where(F.length("run") >= size)
    grams = runs.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - size + 1), lambda i: F.substring("run", i, F.lit(size)))).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def gram_words(docs: DataFrame, keys: Sequence[str], sizes: Sequence[int] = (4, 3, 2), min_count: int = 5) -> DataFrame:
    """n-grams as words with their counts, longest first; parts of a kept longer one are dropped."""
    kept = None
    for size in sorted(sizes, reverse=True):
        found = ngrams(docs, keys, size, min_count)
        if kept is not None:
            inner = kept.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("gram") - size + 1), lambda i: F.substring("gram", i, F.lit(size)))).alias("gram")).distinct()
            found = found.join(inner, [*keys, "gram"], "left_anti")
        kept = found if kept is None else kept.unionByName(found)
    return kept


def mark_counts(docs: DataFrame, keys: Sequence[str], marks: dict[str, str]) -> DataFrame:
    """Totals of punctuation marks per key; marks: name -> regex."""
    counts = [F.sum(F.regexp_count("text", F.lit(rx))).alias(name) for name, rx in marks.items()]
    return docs.groupBy(*keys).agg(*counts, F.sum(F.length("text")).alias("chars"))


def style_profile(docs: DataFrame, keys: Sequence[str], profile: X.Profile = X.LATIN, *, short: int = 15, long: int = 40, bins=(10, 20, 30, 40, 60)) -> DataFrame:
    """Sentence-length profile after removing light marks and spaces, with half-open bins."""
    clean = F.regexp_replace("piece", X.char_class(profile.removed), "")
    rows = docs.select(*keys, F.explode(X.clauses(F.col("text"), profile.enders)).alias("piece")).withColumn("n", F.length(clean)).where("n > 0")
    edges = [0, *bins, None]
    n = F.col("n")
    parts = [F.count_if((n >= lo) & (n < hi) if hi is not None else n >= lo).alias(f"bin_{lo}") for lo, hi in zip(edges, edges[1:])]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg("n"), 4).alias("avg_len"),
        F.round(F.count_if(n < short) / F.count("*"), 4).alias("short_share"),
        F.round(F.count_if(n > long) / F.count("*"), 4).alias("long_share"),
        *parts,
    )


def rhetoric_totals(docs: DataFrame, keys: Sequence[str], patterns: dict[str, str], *, doc: str = "doc_id", examples: int = 3) -> DataFrame:
    """Matches of each pattern per key, the mean a document, and the first documents with any.

    Keys are few and documents many, so the totals are partial sums, and the examples of a
    key are ranked among the first ones of each of many shares of its documents.
    """
    found = docs.select(*keys, doc, F.explode(X.pattern_counts(F.col("text"), patterns)).alias("p")).select(*keys, doc, "p.name", "p.n").where("n > 0")
    sizes = docs.groupBy(*keys).agg(F.count("*").alias("docs"))
    totals = found.groupBy(*keys, F.col("name").alias("figure")).agg(F.sum("n").alias("n"))
    first = found
    for by in ([F.pmod(F.xxhash64(doc), F.lit(SHARES))], []):
        nth = F.row_number().over(W.partitionBy(*keys, "name", *by).orderBy(doc))
        first = first.withColumn("_k", nth).where(F.col("_k") <= examples)
    first = first.groupBy(*keys, F.col("name").alias("figure")).agg(F.sort_array(F.collect_list(doc)).alias("examples"))
    out = totals.join(first, [*keys, "figure"]).join(sizes, list(keys))
    return out.withColumn("per_doc", F.round(F.col("n") / F.col("docs"), 4)).drop("docs")


def sentiment_arc(docs: DataFrame, keys: Sequence[str], positive: str, negative: str, mode: str = "char") -> DataFrame:
    """Mean sentiment per key over its rows."""
    rows = docs.withColumn("_s", X.sentiment(F.col("text"), positive, negative, mode=mode))
    return rows.groupBy(*keys).agg(F.round(F.avg("_s"), 3).alias("score"), F.count("*").alias("n"))


def arc_points(arc: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Key points of an arc: up to six rows give the first three, more give 0, n/3, 2n/3 and the last."""
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    rows = arc.withColumn("_i", F.row_number().over(by.orderBy(order)) - 1).withColumn("_n", F.count("*").over(by))
    i, n = F.col("_i"), F.col("_n")
    keep = F.when(n <= 6, i < 3).otherwise((i == 0) | (i == F.floor(n / 3)) | (i == F.floor(2 * n / 3)) | (i == n - 1))
    return rows.where(keep).drop("_i", "_n")


def foils(scenes: DataFrame, environment: str, text: str = "raw_text", who: str = "who") -> DataFrame:
    """Scenes that have someone in them and name their surroundings."""
    return scenes.where((F.size(who) >= 1) & F.col(text).rlike(environment))


def place_cuts(scenes: DataFrame, keys: Sequence[str], order: Sequence[str], place: str = "where") -> DataFrame:
    """Number of changes of place between neighbouring scenes that both name one."""
    before = F.lag(place).over(W.partitionBy(*keys).orderBy(*order))
    cut = (F.coalesce(before, F.lit("")) != "") & (F.coalesce(F.col(place), F.lit("")) != "") & (before != F.col(place))
    return scenes.withColumn("_cut", cut.cast("int")).groupBy(*keys).agg(F.sum("_cut").alias("cuts"), F.count("*").alias("scenes"))


def speech_share(acts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of speech and action in characters after a first ': '."""
    body = F.when(F.contains("content", F.lit(": ")), F.expr("substring(content, instr(content, ': ') + 2)")).otherwise(F.col("content"))
    rows = acts.withColumn("_n", F.length(body))
    out = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("channel") == "say", F.col("_n")).otherwise(0)).alias("say"),
        F.sum(F.when(F.col("channel") == "do", F.col("_n")).otherwise(0)).alias("do"),
        F.sum("_n").alias("total"),
    )
    whole = F.greatest("total", F.col("say") + F.col("do"), F.lit(1))
    return out.withColumn("say_share", F.round(F.col("say") / whole, 3)).withColumn("do_share", F.round(F.col("do") / whole, 3))


def budget_sample(rows: DataFrame, keys: Sequence[str], *, chars: str, order: Column, ratio: float = 0.1, least: int = 200, shares: dict[str, float] | None = None) -> DataFrame:
    """A stratified sample by a budget of characters; rows have the column kind.

    The target per key is max(least, ratio * characters), dealt to the kinds by shares.
    Rows are taken in the order of a hash of their identity, as hexadecimal digits, until the
    budget is reached, and the row that reaches it is still taken. What long rows leave of
    their share goes to the others. The first digits deal the rows of a key into slices.
    """
    shares = shares or {"long": 0.6, "mid": 0.25, "short": 0.15}
    sizes = rows.groupBy(*keys).agg(
        F.sum(chars).alias("_all"), *[F.sum(F.when(F.col("kind") == k, F.col(chars)).otherwise(0)).alias(f"_{k}") for k in shares]
    )
    target = F.greatest(F.lit(float(least)), F.col("_all") * F.lit(ratio))
    lack = F.greatest(F.lit(0.0), target * shares["long"] - F.col("_long"))
    rest = sum(v for k, v in shares.items() if k != "long")
    budgets = sizes.select(
        *keys,
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in shares]),
            F.array(*[target * v + (F.lit(0.0) if k == "long" else lack * (v / rest)) for k, v in shares.items()]),
        ).alias("_budget"),
    )
    # keys are few and rows many: rows go into slices of the order, whose sums tell where each begins
    rows = rows.withColumn("_o", order)
    rows = rows.withColumn("_slice", F.substring(F.col("_o"), 1, 3))
    by = [*keys, "kind"]
    sums = rows.groupBy(*by, "_slice").agg(F.sum(chars).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")
    starts = sums.withColumn("_start", before).drop("_sum").join(budgets, list(keys)).where(F.col("_start") < F.col("_budget")[F.col("kind")])
    run = W.partitionBy(*by, "_slice").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.join(starts, [*by, "_slice"]).withColumn("_before", F.col("_start") + F.sum(chars).over(run) - F.col(chars))
    return ranked.where(F.col("_before") < F.col("_budget")[F.col("kind")]).drop("_before", "_budget", "_start", "_slice", "_o")


def baseline(ledger: DataFrame, group: str, metric: Sequence[str] = ("metric",)) -> DataFrame:
    """Means per group and over all groups of a ledger (group, metric..., value): one row a book."""
    rows = ledger.withColumn("_value", F.col("value").cast("double"))
    return (
        rows.rollup(*metric, group)
        .agg(F.round(F.avg("_value"), 4).alias("mean"), F.count("*").alias("n_books"), F.grouping(group).alias("_all"), F.grouping(metric[0]).alias("_none"))
        .where("_none = 0")
        .withColumn(group, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(group)))
        .drop("_all", "_none")
    )


def style_words(freq: DataFrame, settings: DataFrame, verbs: DataFrame) -> DataFrame:
    """freq (word, pos, n) with group content (a setting's name) or style; cognitive verbs go."""
    marked = freq.join(F.broadcast(settings.select("word").distinct().withColumn("_c", F.lit(True))), "word", "left")
    known = F.broadcast(verbs.select("word").distinct().withColumn("_v", F.lit(True)))
    marked = marked.join(known, "word", "left")
    gone = F.coalesce("_v", F.lit(False)) & F.col("pos").isin("v", "vn") & F.col("_c").isNull()
    return marked.where(~gone).withColumn("group", F.when(F.col("_c"), "content").otherwise("style")).drop("_c", "_v")
