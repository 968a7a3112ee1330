"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Everything in ASCII that is neither a digit nor a letter separates words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a local
    session gets a temporary folder and any other one a folder in the warehouse,
    which executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        root = f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
    else:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_scopes: list[str] = []


def _folder(spark: SparkSession, *parts: str) -> str:
    return "/".join([f"{scratch_root(spark)}/loomtext-{spark.sparkContext.applicationId}", *parts])


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, *, outer: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back.

    That cuts the lineage at files which survive the loss of any executor, and
    gives the optimizer true sizes for what comes after. outer writes it so that it
    outlasts the scope that is open.
    """
    scopes = _scopes[:-1] if outer else _scopes
    return write(df, _folder(df.sparkSession, *scopes, f"{label}-{uuid.uuid4().hex}"))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession, *, keep: list[str] | None = None) -> Iterator[None]:
    """A folder for the intermediate tables made inside, deleted at the end, or noted in `keep` for later."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    path = _folder(spark, *_scopes)
    try:
        yield
    finally:
        _scopes.pop()
        if keep is None:
            _delete(spark, path)
        else:
            keep.append(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete the folders and forget them."""
    while paths:
        _delete(spark, paths.pop())


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once their results are written."""
    if spark.conf.get("spark.checkpoint.dir", None):
        _delete(spark, _folder(spark))


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """The rows, written with a number `row` of their own and their columns as c0, c1, ...

    What is found for a row goes back to that row alone, whatever ids repeat or are null,
    and no input name can clash.
    """
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return materialize(docs.select(*columns, F.monotonically_increasing_id().alias("row")), label)


def renamed(held: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of numbered() under their own names again."""
    return held.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most `rows` rows travel to Python at once, since the rows here hold long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


_kept: dict[str, Callable[[], object]] = {}


def keeps(name: str, clear: Callable[[], object]) -> None:
    """In a Python worker: an operator begins, and what others keep in this process goes.

    Workers serve the tasks of all stages, so they would hold the caches of each at once.
    """
    others = [k for k in _kept if k != name]
    for k in others:
        _kept.pop(k)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    _kept[name] = clear


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and leave all other characters as they are."""
    return F.translate(col, UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """Lower-cased words of a text as an array; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def shifted(words: Column, by: int) -> Column:
    """The array from its element number `by` on, to zip with itself."""
    return F.slice(words, by + 1, F.size(words))
