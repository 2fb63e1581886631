"""Counters, cumulative histograms and gauges over observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of response time buckets, in seconds.
BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]


def counter(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("value"))


def histogram(rows: DataFrame, labels: list[str], value: Column, buckets: list[float] = BUCKETS) -> DataFrame:
    """One row a label set: cumulative counts le_<bound>, le_inf, sum and count, in one pass."""
    les = [F.sum(F.when(value <= b, 1).otherwise(0)).alias("le_" + str(b).replace(".", "_")) for b in buckets]
    return rows.groupBy(*labels).agg(*les, F.count(value).alias("le_inf"), F.round(F.sum(value), 4).alias("sum"), F.count(value).alias("count"))


def info(spark, **constants: str):
    """One row of constants."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in constants.items()))


def exposition(rows: DataFrame, name: str, kind: str, labels: list[str], value: str = "value") -> DataFrame:
    """The text form of a metric, one line a label set: name{label="value"} number. Lines carry their order."""
    quoted = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    inside = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), quoted(c), F.lit('"')) for c in labels))
    lines = rows.select(F.lit(1).alias("part"), F.concat(F.lit(name + "{"), inside, F.lit("} "), F.col(value).cast("string")).alias("line"))
    head = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(f"# TYPE {name} {kind}").alias("line"))
    return head.unionByName(lines)


def gauge(rows: DataFrame, labels: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """The value set last."""
    return rows.groupBy(*labels).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


def info_series(rows: DataFrame, **labels: str) -> DataFrame:
    """An info metric from a table: one series of value 1 for each distinct set of labels (name = column)."""
    return rows.select(*(F.col(c).alias(name) for name, c in labels.items())).distinct().withColumn("value", F.lit(1))
