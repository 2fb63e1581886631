"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs: lines, cut at ends of sentences and, where neither comes, after 256 code
points. The pieces join to the text again, so equal leaves mean equal texts. A section is a run of
leaves that ends at a leaf whose digest ends in 0 (one in 16): its bounds follow from content, so an
edit moves no bound after it. Section digests cover their leaves, the root covers the sections.

A fingerprint is `root|leaf.leaf/leaf.leaf`: the root's SHA-256, then by section the first 40 bits of
each leaf's digest. Equal roots mean equal texts; else differing sections and leaves locate the edits.

Only DataFrame functions. Defined results: null counts as the empty text, which has one empty leaf;
rows whose doc_id is null stand last; repeated rows are documents of their own; tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: One leaf: up to the end of a line or sentence, or 256 code points.
LEAF = r"(?s).{0,254}?(?:[.!?]\x20|\n)|.{1,256}"
LEAF_HEX = 10
#: Texts are dealt into this many ranges of doc_id for each shuffle partition.
RANGES_A_PARTITION = 2


def fingerprint(text: Column) -> Column:
    """The tree of a text, as a string."""
    leaves = F.array_join(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEAF), F.lit(0)), lambda x: F.md5(x)), ".")
    # A section's end stays with it; look-behind cuts without taking a character.
    sections = lambda x: F.split(x, r"(?<=0\.)")
    tree = F.transform(
        F.array(leaves),
        lambda x: F.concat_ws(
            "|",
            F.sha2(F.array_join(F.transform(sections(x), lambda s: F.sha2(s, 256)), "/"), 256),
            F.regexp_replace(F.regexp_replace(x, r"0\.", "0/"), rf"(?<=^|[./])([0-9a-f]{{{LEAF_HEX}}})[0-9a-f]*", "$1"),
        ),
    )
    return F.element_at(tree, 1)


def _part(fp: Column, k: int) -> Column:
    return F.element_at(F.split(fp, r"\|"), k)


def likeness(one: Column, other: Column) -> Column:
    """1 for equal roots; else twice the distinct leaves in both by the sum of each one's, under 1."""
    leaves = lambda x: F.array_distinct(F.split(_part(x, 2), "[./]"))
    pair = F.transform(F.array(F.struct(leaves(one).alias("a"), leaves(other).alias("b"))), lambda p: F.size(F.array_intersect(p["a"], p["b"])) * 2.0 / (F.size(p["a"]) + F.size(p["b"])))
    return F.when(_part(one, 1) == _part(other, 1), F.lit(1.0)).otherwise(F.least(F.element_at(pair, 1), F.lit(0.999999)))


def locate(one: Column, other: Column) -> Column:
    """Where two texts differ: struct of the sections (from 1) of each that have no equal in the other, empty for equal texts."""
    parts = lambda x: F.split(_part(x, 2), "/")
    lone = lambda x, y: F.filter(F.transform(parts(x), lambda s, i: F.when(~F.array_contains(parts(y), s), i + 1)), lambda i: i.isNotNull())
    return F.struct(lone(one, other).alias("left_only"), lone(other, one).alias("right_only"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with next_<c> for each of columns, in place of columns of these names: its value in the next row by descending doc_id; the last row's next is the first.

    One shuffle: rows go by range of doc_id, with the top row of the range below added to each range,
    so a window needs no row of another range. Ranges hold about equal counts (quantiles of doc_id),
    their number is bounded by the shuffle partitions, and only their bounds come to the driver.
    """
    spark = docs.sparkSession
    # columns of docs travel under names of our own, so none can clash with what is made here
    names = [c for c in docs.columns if c not in {f"next_{x}" for x in columns}]
    inner = {c: "doc_id" if c == "doc_id" else f"in{i}" for i, c in enumerate(names)}
    docs, order_by = docs.select(*(F.col(c).alias(inner[c]) for c in names)), [inner[c] for c in columns]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_A_PARTITION
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    # Range 0 holds the smallest ids (and null ones), range k those above cuts[k - 1].
    held = F.lit(0) if not cuts else F.coalesce(F.size(F.filter(F.lit(cuts), lambda c: F.col("doc_id") > c)), F.lit(0))
    placed = docs.withColumn("_range", held)
    tops = {r["_range"]: r["top"] for r in placed.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    above = {tops[low]: high for low, high in zip(order, order[1:] + order[:1]) if tops[low] is not None}
    edges = docs.filter(F.col("doc_id").isin(list(above)))
    to = F.element_at(F.create_map(*(F.lit(x) for kv in above.items() for x in kv)), F.col("doc_id")) if above else F.lit(0)
    both = placed.withColumn("_extra", F.lit(0)).unionByName(edges.withColumn("_range", to.cast("int")).withColumn("_extra", F.lit(1)))
    w = Window.partitionBy("_range").orderBy("_extra", F.col("doc_id").desc_nulls_last(), *order_by)
    ahead = both.repartition(ranges, "_range").withColumns({f"next{i}": F.lead(inner[c]).over(w) for i, c in enumerate(columns)})
    return ahead.filter("_extra = 0").select(*(F.col(inner[c]).alias(c) for c in names), *(F.col(f"next{i}").alias(f"next_{c}") for i, c in enumerate(columns)))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs, ["text"])
    n = F.length("text")
    near = near.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "text",
        F.coalesce("next_text", F.lit("")).alias("following"),
    )
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 2)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept.cast("int")), F.substring(F.col("following"), F.lit(1), (F.col("n_chars") - kept).cast("int")))
    near = near.withColumn("edited", edited)
    near = near.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("following")).alias("_next"),
    )
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
        locate(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_at"),
    )
