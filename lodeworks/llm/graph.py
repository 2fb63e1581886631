"""Connected components of an undirected graph, by large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, join_class


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node with an edge to another: root is the smallest node reachable.

    Each round hangs larger neighbours on the smallest one; the number of rounds grows with the
    logarithm of the diameter. Neighbourhoods are only reduced to their minimum, never collected.
    """
    star = cut(_down(edges))
    before = (star.count(),)
    for _ in range(most_rounds):
        both = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        # a star's centre may have most edges: join_class lets no key gather its rows in one task
        large = join_class(both.filter("b > a"), least, "a", "n", 2 * before[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, star = star, cut(_down(large))
        drop_cut(least)
        drop_cut(last)
        least = cut(star.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_class(star, least, "a", "n", before[0])
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, star = star, cut(_down(small))
        drop_cut(least)
        drop_cut(last)
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            found = cut(star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
            drop_cut(star)
            return found
        before = now
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
