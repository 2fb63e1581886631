"""As-of join: for each row of one table the last row of another, of the same key, not after it in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket of time.
WIDTH_S = 6 * 3600


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, take: str, width_s: int = WIDTH_S) -> DataFrame:
    """left with `take`, the value of right's row of the same key with the largest ts that is not after left's; null without one.

    Keys may be few and hold most rows, so a window over a key would be one task: a window runs over a key's rows of one
    bucket of time, and what was last before a bucket comes from a window over buckets, of which a key has as many as its time span has.
    At equal times the largest `take` counts. ts is a timestamp_ntz or timestamp of both; rows of left without it get null.
    """
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / width_s)
    held = right.filter(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_ts"), F.struct(F.col(ts).alias("t"), F.col(take).alias("v")).alias("_r"), bucket.alias("_bucket"))
    named = left.withColumn("_l", F.struct(*left.columns)).select(*by, F.col(ts).alias("_ts"), "_l", bucket.alias("_bucket"))
    # The last of each bucket, carried to every bucket that either side has.
    last = held.groupBy(*by, "_bucket").agg(F.max("_r").alias("_top"))
    both = last.unionByName(named.select(*by, "_bucket").distinct().withColumn("_top", F.lit(None).cast(last.schema["_top"].dataType))).groupBy(*by, "_bucket").agg(F.max("_top").alias("_top"))
    w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = both.withColumn("_before", F.last("_top", ignorenulls=True).over(w)).select(*by, "_bucket", "_before")
    rows = named.withColumn("_r", F.lit(None).cast(held.schema["_r"].dataType)).withColumn("_side", F.lit(1))
    rows = rows.unionByName(held.withColumn("_l", F.lit(None).cast(named.schema["_l"].dataType)).withColumn("_side", F.lit(0)))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_ts", "_side", F.col("_r.v")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_in", F.last("_r", ignorenulls=True).over(inside)).filter("_side = 1")
    found = found.join(before, [*by, "_bucket"], "left")
    return found.select("_l.*", F.coalesce(F.col("_in.v"), F.col("_before.v")).alias(take))


def wall(ts: Column, zone: str) -> Column:
    """What the clock shows in a zone at a UTC time (both timestamp_ntz)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def utc(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
