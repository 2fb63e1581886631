"""Tables in the folder that driver and executors share: where a plan's lineage ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if all runs in one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get rows in batches of at most so many bytes and rows, unless the session says otherwise."""
    for key, most in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, read again: computed once however often it is read, and whole if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
