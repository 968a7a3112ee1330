"""Table readers and the schemas that they promise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df, if it has all expected columns with their types; extra columns are fine."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in have]
    wrong = [f"{f.name}: {have[f.name].simpleString()}" for f in expected.fields if f.name in have and have[f.name] != f.dataType]
    if missing or wrong:
        raise ValueError(f"missing columns {missing}, other types {wrong}")
    return df


def scenes_done(scenes: DataFrame, last_chapter: int | None = None) -> DataFrame:
    """Extracted scenes up to a chapter, in reading order; the filter reaches the scan."""
    rows = scenes.where(F.col("extract_status") == "ok")
    if last_chapter is not None:
        rows = rows.where(F.col("chapter_no") <= last_chapter)
    return rows.orderBy("chapter_no", "scene_id")


def scene_meta(scenes: DataFrame, last_chapter: int | None = None, raw_chars: int = 400) -> DataFrame:
    """scenes_done() with the raw text cut to a budget."""
    return scenes_done(scenes, last_chapter).withColumn("raw_text", F.substring("raw_text", 1, raw_chars))


def by_chapter(scenes: DataFrame, order: str = "scene_id", chapter: str = "chapter_no") -> DataFrame:
    """(chapter, scenes): the scenes of a chapter as an ordered array of structs."""
    item = F.struct(order, *[c for c in scenes.columns if c not in (order, chapter)])
    return scenes.groupBy(chapter).agg(F.array_sort(F.collect_list(item)).alias("scenes"))


def json_products(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents of a known shape; absent files give an empty table, broken rows are dropped."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read_as = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    try:
        rows = spark.read.schema(read_as).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", "true").json(path)
        rows.schema  # noqa: B018  the path is looked up here
    except Exception as e:  # AnalysisException for a path that is not there
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return rows.where("_broken IS NULL").drop("_broken")


def log_records(spark: SparkSession, path: str, schema: str = "ts timestamp, level string, step string, msg string, name string, value double, chapter int, done long, total long") -> DataFrame:
    """Records of a JSONL log; blank lines and broken records are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def newest_run(runs: DataFrame, book: str | None = None) -> DataFrame:
    """The newest product folder of (book, path, mtime), of the current book if it has any."""
    prefer = F.struct((F.col("book") == F.lit(book)).cast("int") if book else F.lit(0), F.col("mtime"))
    return runs.agg(F.max_by("path", prefer).alias("path"), F.max_by("book", prefer).alias("book"))


def union_roots(*roots: DataFrame) -> DataFrame:
    """Product rows of several roots, each once."""
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return out.distinct()


def latest_by_key(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key: upsert by union and row number."""
    order = W.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def seconds_of(log: DataFrame, column: str = "value", pattern: str = r"耗时\s*([0-9.]+)\s*s") -> DataFrame:
    """The first elapsed time that a text log reports, per file."""
    found = F.regexp_extract(column, pattern, 1)
    return log.where(found != "").select(F.input_file_name().alias("file"), found.cast("double").alias("seconds"), F.monotonically_increasing_id().alias("_i")).groupBy("file").agg(F.min_by("seconds", "_i").alias("seconds"))
