"""Small tables with the awkward cases that every operator must take."""

import duckdb
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that an operator might use for its own columns
        T.StructField("key", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("_key", T.StringType()),
        T.StructField("_d", T.StringType()),
    ]
)


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = []
    for row in rows:
        doc_id, text, *lang = row
        full.append((doc_id, text, lang[0] if lang else None, None, None, "x", 7, "no", "s", None, "d"))
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "One"),
    (5, "one"),
    (6, LONG),
    (7, LONG.upper()),
    (8, "É é Ü ü the Same Text\nwith lines"),
    (9, "É é Ü ü THE same text\nwith lines"),
    (10, "é é ü ü the same text\nwith lines"),
    (None, "a row without an id"),
    (12, "a row without an id"),
    (13, "twice the same row"),
    (13, "twice the same row"),
]


def write_tables(spark, folder, rows, **others):
    """Parquet tables under folder: documents, and others by name as (rows, schema)."""
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name, (more, schema) in others.items():
        spark.createDataFrame(more, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def query(spark, folder, name):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, folder)


def same_as_sql(spark, folder, name, rows, **others):
    """The registered query over these tables gives what its SQL gives, columns and rows."""
    import __spark_entry__

    folder = write_tables(spark, folder, rows, **others)
    got = query(spark, folder, name)
    db = duckdb.connect()
    for t in ["documents", *others]:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    have = sorted((tuple(r) for r in got.collect()), key=repr)
    assert have == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
    return have
