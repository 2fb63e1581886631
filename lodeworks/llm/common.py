"""Shared folder handling for the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple] = []
_settled = 0.0
#: Seconds between two collections of the driver's garbage, at least.
SETTLE_S = 2.0
#: A key is hot with more than one in so many of all rows.
HOT_SHARE = 1000
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get rows in batches of at most so many bytes and rows, unless the session says otherwise: texts vary from one word to books."""
    for key, most in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")  # for this write alone: its shuffles are read by nothing later
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)
    _made.append((spark, path))
    _settle(spark)
    held = spark.read.schema(df.schema).parquet(path)
    held._lodeworks_cut = path
    return held


def join_class(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left join classes, which has one row a key; its column `size`, which is dropped, counts the rows of the key.

    A key with more than a thousandth of all rows is met by a broadcast: there can't be a thousand of them.
    So no key, and no null, gathers its rows in one task.
    """
    from pyspark.sql import functions as F

    hot = F.col(size) > total // HOT_SHARE
    large, small = F.broadcast(classes.filter(hot).drop(size)), classes.filter(~hot).drop(size)
    more = [f for f in classes.schema.fields if f.name not in (key, size)]
    alone = rows.filter(F.col(key).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in more})
    rest = rows.filter(F.col(key).isNotNull())
    return rest.join(large, key).unionByName(rest.join(large.select(key), key, "left_anti").join(small, key, "left")).unionByName(alone)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind the table that cut() returned, when no later step reads its rows."""
    _delete(df.sparkSession, df._lodeworks_cut)


def _settle(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage between steps, at most once in SETTLE_S seconds.

    Spark frees what finished steps' plans, broadcasts and shuffles hold on to only after a collection, and a heap that
    is never collected whole grows to its limit, however little of it is in use.
    """
    global _settled
    if time.monotonic() - _settled >= SETTLE_S:
        spark.sparkContext._jvm.System.gc()
        _settled = time.monotonic()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended; its owner clears the folder
            return
