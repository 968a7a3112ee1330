"""Session construction with the settings that the plans in this package rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    master: str = "local[*]",
    *,
    shuffle_partitions: int | None = None,
    driver_memory: str = "8g",
    app_name: str = "loomtext",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, UTC time and dynamic partition overwrite."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
