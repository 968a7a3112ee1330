"""Vector functions over arrays of numbers, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def hashed_bigrams(text: Column, dim: int = 64) -> Column:
    """A deterministic offline embedding: counts of character bigrams, hashed to dim buckets."""
    n = F.greatest(F.length(text) - 1, F.lit(0))
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    slots = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(dim)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("float"))
