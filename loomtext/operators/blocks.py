"""Small sides of theta joins, sent in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, key: str, limit: int) -> list[DataFrame]:
    """The rows in as many parts by key as keep each at about half the limit, or whole if they are within it."""
    count = rows.count()
    n = 1 if count <= limit else -(-2 * count // limit)
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]
