"""Session factory and the few settings every query relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "lodeworks", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC times and adaptive execution.

    Shuffle partitions are left to the cluster's own setting unless given, and AQE
    coalesces them to the advisory size, so the same code serves 1 MB and 100 TB.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
