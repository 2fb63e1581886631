"""Exports for corpora and instruction tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alpaca(turns: DataFrame) -> DataFrame:
    """instruction, input, output for each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = turns.withColumn("_role", F.lead("role").over(w)).withColumn("output", F.lead("text").over(w))
    return df.filter("role = 'user' AND _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), F.lit("").alias("input"), "output")


def sharegpt(turns: DataFrame) -> DataFrame:
    """One JSON array of {from, value} a conversation."""
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    items = F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value"))))
    return turns.groupBy("conv_id").agg(F.to_json(F.transform(items, lambda m: F.struct(m["from"], m["value"]))).alias("conversations"))


def corpus_lines(pages: DataFrame, unit: str, title: str) -> DataFrame:
    return pages.select("url", F.lit(unit).alias("unit"), F.lit(title).alias("title"), F.col("text").alias("content"))
