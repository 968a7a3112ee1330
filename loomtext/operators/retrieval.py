"""Retrieval: inverted index with BM25, containment fallback, vectors, layered term search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .blocks import in_blocks


def search_text(actinfo: Column, *others: Column) -> Column:
    """The text to search: contents and scopes of the acts, else the other columns."""
    acts = F.array_join(F.transform(actinfo, lambda a: F.concat_ws(" ", a["content"], F.array_join(a["scope"], " "))), " ")
    return F.when(F.size(actinfo) > 0, acts).otherwise(F.concat_ws(" ", *others))


def tokens(text: Column) -> Column:
    """Lower-cased words; runs of Han characters as overlapping pairs."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(r"(\p{IsHan}+)"), F.lit(1))
    pairs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))),
        )
    )
    return F.concat(words, pairs)


def build_index(docs: DataFrame, key: str, text: str, tokenise=tokens, terms: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, tf), of all terms or of those given, and lengths (key, n)."""
    rows = docs.select(key, tokenise(F.col(text)).alias("_t"))
    wanted = F.col("_t") if terms is None else F.filter("_t", lambda t: t.isin(*terms))
    postings = rows.select(key, F.explode(wanted).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return postings, rows.select(key, F.size("_t").alias("n"))


def bm25(postings: DataFrame, lengths: DataFrame, key: str, terms: Sequence[str], *, k1: float = 1.2, b: float = 0.75, limit: int = 10) -> DataFrame:
    """(key, score): the best documents for the terms. Only their postings are read."""
    wanted = postings.where(F.col("term").isin(*terms))
    stats = lengths.agg(F.count("*").alias("_docs"), F.avg("n").alias("_avg"))
    df = wanted.groupBy("term").agg(F.count("*").alias("_df"))
    hits = wanted.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("_avg")))
    return hits.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def containing(docs: DataFrame, key: str, text: str, query: str, limit: int = 10) -> DataFrame:
    """The first documents that contain the query."""
    return docs.where(F.contains(text, F.lit(query))).select(key).orderBy(key).limit(limit)


def full_text(docs: DataFrame, postings: DataFrame, lengths: DataFrame, key: str, text: str, query: str, limit: int = 10) -> DataFrame:
    """(key, score) by BM25; where that finds nothing, documents that contain the query, score 0."""
    spark = docs.sparkSession
    terms = spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]
    found = bm25(postings, lengths, key, terms, limit=limit)
    if terms and not found.isEmpty():
        return found
    return containing(docs, key, text, query, limit).withColumn("score", F.lit(0.0))


def nearest(vectors: DataFrame, key: str, vec: str, query: Sequence[float], limit: int = 10) -> DataFrame:
    """(key, score): cosine top-k, the larger key first on ties. One scan and a bounded heap per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, V.cosine(F.col(vec), q).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc(key)).limit(limit)


def _rounded(x: float) -> float:
    """Six decimals, halves up in the decimal notation of x, as round() of the engine."""
    return float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0


def _sequential(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in order as vectors.dot() does, so that no digit differs from it."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out = out + x[:, d] * y[:, d]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _plain(vec: str, dim: int) -> Column:
    """Vectors of dim finite numbers, none too small or large to be squared; false for null."""
    size = F.expr(f"aggregate(`{vec}`, 0D, (s, x) -> s + cast(x AS DOUBLE) * cast(x AS DOUBLE))")
    return F.coalesce((F.size(vec) == dim) & ((size == 0) | size.between(1e-200, 1e200)), F.lit(False))


def _best_plain(vectors: DataFrame, part: DataFrame, key: str, query: str, vec: str, limit: int) -> DataFrame:
    """(query, key, score): of each batch of vectors, the best `limit` of every query, ties included by key.

    A matrix product finds what may be among the best, with a margin far over its error; those
    are scored again in the order of vectors.dot(), so the choice is exact. Equal vectors of a
    batch count once, with their largest keys.
    """
    table = part.select(F.col(query), F.col(vec)).toArrow()
    names, matrix = table.column(0).combine_chunks(), _matrix(table.column(1).combine_chunks(), len(table.column(1)[0]))
    sent = vectors.sparkSession.sparkContext.broadcast((names, matrix))
    dim = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        q_norm = np.sqrt(_sequential(q, q))
        unit = q / np.where(q_norm == 0, 1, q_norm)[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(batch.column(0), sort_keys=[("", "descending")]).to_numpy()  # large keys first
            x = _matrix(batch.column(1), dim)[order]
            _, of = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * dim))).ravel(), return_inverse=True)
            by = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.diff(of[by], prepend=-1))
            ends = np.append(starts[1:], len(by))
            x = x[by[starts]]  # distinct vectors
            norm = np.sqrt(_sequential(x, x))
            own = x / np.where(norm == 0, 1, norm)[:, None]
            asked, met, scores = [], [], []
            for at in range(0, len(q), 256):
                near = unit[at : at + 256] @ own.T
                k = min(limit, near.shape[1])
                floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 3e-6
                i, j = np.nonzero(near >= floor[:, None])
                scale = norm[j] * q_norm[at + i]
                dots = np.concatenate([_sequential(x[j[n : n + 65536]], q[at + i[n : n + 65536]]) for n in range(0, len(j), 65536)])
                score = np.where(scale == 0, 0.0, dots / np.where(scale == 0, 1, scale))
                for row in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                    places = [(-_rounded(score[c]), p, c) for c in row.tolist() for p in by[starts[j[c]] : min(ends[j[c]], starts[j[c]] + limit)].tolist()]
                    for _, p, c in heapq.nsmallest(limit, places):
                        asked.append(at + i[c])
                        met.append(order[p])
                        scores.append(score[c])
            columns = [names.take(pa.array(asked, pa.int64())), batch.column(0).take(pa.array(met, pa.int64())), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "k", "score"])

    kinds = part.schema[query].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    out = vectors.select(key, vec).mapInArrow(run, f"q {kinds[0]}, k {kinds[1]}, score double")
    return out.select(F.col("q").alias(query), F.col("k").alias(key), F.round("score", 6).alias("score"))


def nearest_each(vectors: DataFrame, queries: DataFrame, key: str, query: str, vec: str, limit: int = 10, max_queries: int = 10_000) -> DataFrame:
    """(query, key, score, rank) of a table of queries, in blocks of about `max_queries` at most.

    The queries of a block are sent to every task, where vectors meet them as matrices. What is no
    plain vector of numbers, as long as most are, meets the others in a join instead.
    """
    order = W.partitionBy(query).orderBy(F.desc("score"), F.desc(key))
    lengths = queries.groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = lengths["n"] if lengths is not None and lengths["n"] is not None and lengths["n"] > 0 else 0
    plain = _plain(vec, dim) if dim else F.lit(False)
    fit, odd = vectors.where(plain), vectors.where(~plain)
    sure, other = queries.where(plain), queries.where(~plain)

    def joined(some: DataFrame, part: DataFrame) -> DataFrame:
        q = part.select(F.col(query).alias("_q"), F.col(vec).alias("_v"))
        met = some.select(key, F.col(vec).alias("_x")).join(F.broadcast(q), F.lit(True))
        return met.select(F.col("_q").alias(query), key, F.round(V.cosine(F.col("_x"), F.col("_v")), 6).alias("score"))

    scored = []
    if not sure.isEmpty():
        scored += [_best_plain(fit, part, key, query, vec, limit) for part in in_blocks(sure, query, max_queries) if not part.isEmpty()]
        if not odd.isEmpty():
            scored += [joined(odd, part) for part in in_blocks(sure, query, max_queries)]
    if not other.isEmpty() or not scored:
        scored += [joined(vectors, part) for part in in_blocks(other, query, max_queries)]
    return reduce(DataFrame.union, scored).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def embed_cached(texts: DataFrame, cache: DataFrame, model: str, embed=V.hashed_bigrams) -> tuple[DataFrame, DataFrame]:
    """(vectors, new): vectors of texts by content key, and the rows to append to the cache.

    cache: (key, model, vec). Only keys that it lacks are embedded, each once.
    """
    from ..functions.text import content_key

    keyed = texts.withColumn("key", content_key(F.lit(model), F.col("text")))
    new = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti").select("key", F.lit(model).alias("model"), embed(F.col("text")).alias("vec"))
    both = cache.select("key", "vec").unionByName(new.select("key", "vec"))
    return keyed.join(both, "key", "left"), new


def context_for_term(scenes: DataFrame, term: str, columns: Sequence[str], *, order: Sequence[str], blobs: int = 3, limit: int = 4) -> DataFrame:
    """The first scenes that mention a term, with up to `blobs` of the texts that do."""
    texts = F.array_compact(F.array(*[F.col(c) for c in columns]))
    hits = F.filter(texts, lambda t: F.contains(t, F.lit(term)))
    return scenes.withColumn("blobs", F.slice(hits, 1, blobs)).where(F.size("blobs") > 0).orderBy(*order).limit(limit)


def layered_search(queries: DataFrame, nodes: DataFrame, *, top: int = 10, in_scope: Column | None = None, max_nodes: int = 200_000) -> DataFrame:
    """(query, id, score, rank): exact 1.0, prefix 0.8, substring 0.6, one edit 0.45.

    nodes: (id, ord). The first layer that fits counts; a layer stops at 3 * top; edits
    are tried only for queries of two characters or more that have fewer than `top` hits.
    The nodes are sent to the tasks in blocks of about `max_nodes` at most.
    """
    rows = nodes if in_scope is None else nodes.where(in_scope)
    rows = rows.select("id", "ord")
    q, n = F.col("query"), F.col("id")
    edit = (F.length(q) >= 2) & (F.levenshtein(q, n, 1) >= 0)
    score = (
        F.when(q == n, 1.0)
        .when(n.startswith(q) | q.startswith(n), 0.8)
        .when(F.contains(n, q) | F.contains(q, n), 0.6)
        .when(edit, 0.45)
    )
    layer = W.partitionBy("query", "score").orderBy("ord")
    asked = queries.select("query").distinct()

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("_k", F.row_number().over(layer)).where(F.col("_k") <= 3 * top)

    parts = [asked.join(F.broadcast(part), (q != "") & (n != "") & score.isNotNull()).withColumn("score", score) for part in in_blocks(rows, "id", max_nodes)]
    met = first(parts[0]) if len(parts) == 1 else first(reduce(DataFrame.union, [first(part).drop("_k") for part in parts]))
    before = F.count(F.when(F.col("score") > 0.45, 1)).over(W.partitionBy("query"))
    met = met.withColumn("_b", before).where((F.col("score") > 0.45) | (F.col("_b") < top))
    order = W.partitionBy("query").orderBy(F.desc("score"), "ord")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "id", "score", "rank")


def acts_text(actinfo: Column, place: Column, notes: Column) -> Column:
    """Acts as lines: the place first, notes last."""
    lines = F.transform(
        actinfo,
        lambda a: F.when(a["type"] == "event", F.concat(F.lit("* "), a["content"])).otherwise(F.concat(a["who"], F.lit(" ["), a["channel"], F.lit("] "), a["content"])),
    )
    return F.concat_ws("\n", F.nullif(place, F.lit("")), F.array_join(lines, "\n"), F.nullif(notes, F.lit("")))


def rag_context(hits: DataFrame, scenes: DataFrame, key: str, text: str, chapter: str) -> DataFrame:
    """One row: the context lines of the hits in order of score."""
    rows = hits.join(scenes.select(key, chapter, text), key)
    line = F.format_string("[第%d章·scene%d] %s", F.col(chapter), F.col(key), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), key, line.alias("line"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))
