"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' rows of a tree domain - language - source. Weights are integers at each node; a
node's capacity is its tokens times EPOCHS. From the root down, a node's budget fills its children in
proportion to their weights, no child beyond its capacity: what one child lacks goes to its siblings
first, and since a node never gets more than all below it can hold, only what a whole subtree lacks
goes to the siblings of its ancestors. Each filling has a closed form over children ordered by capacity
per weight, here as windows by parent, in exact integers.

A leaf takes whole epochs and then a prefix of one more, each epoch in its own order, by MD5 of seed,
epoch and doc_id: documents until the tokens before reach the budget. Prefixes are found by sums over
4096 hash ranges of a leaf and a window inside the one range where the budget ends, so a leaf with a
third of all rows is no more work for one task than any other. Rows come to no driver.

Children of equal capacity and weight are filled alike, so windows run over the distinct pairs of the two.

Defined results: null text has no tokens, null language or source is the node ``; rows repeated under
one doc_id share a place and are taken together, and so do rows without doc_id; a leaf without tokens
gives nothing; texts of any length are counted whole; an empty table gives an empty one; mix_documents
with keep_text returns every column of docs, whatever its name, and without it none but those listed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LEVELS = ("domain", "language", "origin")
#: Tokens are words between these characters.
BLANKS = r"[\x20\x09-\x0D]+"
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    seed: str = "mix-1"
    epochs: int = 2
    #: The budget as a share of all tokens: numerator, denominator.
    share: tuple[int, int] = (1, 2)
    #: Weights by node name at each level; others have weight 1.
    domain: dict = field(default_factory=lambda: {"web": 2, "books": 3, "forum": 1})
    language: dict = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    origin: dict = field(default_factory=lambda: {"src0": 1, "src1": 2})


PRODUCTION = Mix()


def domain_of(source: Column) -> Column:
    """The domain of a source, from the first hexadecimal digit of its MD5."""
    d = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(d <= "6", "web").when(d <= "b", "books").otherwise("forum")


def tokens_of(text: Column) -> Column:
    return F.when(F.coalesce(F.length(F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", ""), BLANKS))
    ).cast("long")


def leaf_columns() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "language": F.coalesce("lang", F.lit("")), "origin": F.coalesce("source", F.lit(""))}


def order_key(mix: Mix, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _weight(names: dict, node: str) -> Column:
    out = F.lit(1)
    for name, w in names.items():
        out = F.when(F.col(node) == name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def _fill(nodes: DataFrame, parents: list[str], node: str) -> DataFrame:
    """nodes have w, cap and the parent's budget b; adds budget, each node's part of b."""
    # Children of one capacity per weight are all full or all not: a row for each capacity and weight is enough.
    each, wide = nodes, lambda c: c.cast("decimal(38,0)")
    nodes = nodes.groupBy(*parents, "b", F.col("cap").alias("cap1"), F.col("w").alias("w1")).agg(wide(F.sum("cap")).alias("cap"), wide(F.sum("w")).alias("w"))
    order = [F.col("cap1").cast("double") / F.col("w1").cast("double"), F.col("cap1"), F.col("w1")]
    w = Window.partitionBy(*parents).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    # Sums and products stay within decimals: capacities and weights as wide integers.
    nodes = nodes.withColumn("_held", F.coalesce(F.sum("cap").over(before), zero).cast("decimal(30,0)")).withColumn("_share", F.sum("w").over(after).cast("decimal(8,0)"))
    nodes = nodes.withColumn("_full", F.col("cap1").cast("decimal(29,0)") * F.col("_share") <= (F.col("b").cast("decimal(28,0)") - F.col("_held").cast("decimal(28,0)")) * F.col("w1").cast("decimal(8,0)"))
    all_ = Window.partitionBy(*parents)
    nodes = nodes.withColumn("_rest", (F.max("b").over(all_) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(all_), zero)).cast("decimal(29,0)"))
    nodes = nodes.withColumn("_left", F.sum(F.when(~F.col("_full"), F.col("w"))).over(all_).cast("decimal(8,0)"))
    part = F.expr("cast(_rest * cast(w1 as decimal(8,0)) as decimal(38,0)) div cast(_left as decimal(38,0))")
    filled = nodes.select(*parents, F.col("cap1").alias("cap"), F.col("w1").alias("w"), F.when(F.col("_full"), F.col("cap1")).otherwise(part).cast("decimal(38,0)").alias("budget"))
    return each.join(filled, [*parents, "cap", "w"])


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: LEVELS and tokens. Adds budget (long)."""
    d, lang, o = LEVELS
    wide = lambda c: c.cast("decimal(38,0)")
    cap = wide(F.sum(F.col("tokens") * mix.epochs))
    num, den = mix.share
    top = leaves.groupBy(d).agg(cap.alias("cap"), wide(F.sum("tokens")).alias("t")).withColumn("w", _weight(mix.domain, d))
    whole = F.sum("t").over(Window.partitionBy())
    top = top.withColumn("b", wide(F.least(F.expr(f"cast(0 as decimal(38,0))") + F.floor(whole * num / den), F.sum("cap").over(Window.partitionBy()))))
    top = cut(_fill(top, [], d).select(d, F.col("budget").alias("b")))  # a filled level is read twice by the next: as a table it is planned once
    mid = leaves.groupBy(d, lang).agg(cap.alias("cap")).withColumn("w", _weight(mix.language, lang)).join(top, d)
    mid = cut(_fill(mid, [d], lang).select(d, lang, F.col("budget").alias("b")))
    low = leaves.withColumn("cap", wide(F.col("tokens") * mix.epochs)).withColumn("w", _weight(mix.origin, o)).join(mid, [d, lang])
    return _fill(low, [d, lang], o).select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def cutoffs(slim: DataFrame, mix: Mix) -> DataFrame:
    """slim: doc_id, LEVELS, tokens. For each leaf and epoch that takes rows: the last order key it takes."""
    leaves = cut(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    leaves = cut(budgets(leaves, mix))
    keyed = slim.withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in range(mix.epochs))))).withColumn("key", order_key(mix, F.col("epoch")))
    keyed = keyed.withColumn("bin", F.substring("key", 1, 3))
    rest = F.least(F.greatest(F.col("budget") - F.col("epoch") * F.col("leaf_tokens"), F.lit(0)), F.col("leaf_tokens"))
    per = [*LEVELS, "epoch"]
    bins = keyed.groupBy(*per, "bin").agg(F.sum("tokens").alias("n"), F.max("key").alias("last"))
    bins = bins.join(leaves.withColumnRenamed("tokens", "leaf_tokens"), list(LEVELS)).withColumn("rest", rest)
    run = Window.partitionBy(*per).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = cut(bins.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).filter("before < rest").select(*per, "bin", "n", "last", "before", "rest"))
    # In all bins but the last one taken, every row is; in that one the rows are put in order.
    ends = bins.filter("before + n >= rest")
    inside = keyed.join(ends, [*per, "bin"]).groupBy(*per, "bin", "key", "before", "rest").agg(F.sum("tokens").alias("k"))
    w = Window.partitionBy(*per, "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("ahead", F.col("before") + F.coalesce(F.sum("k").over(w), F.lit(0))).filter("ahead < rest").select(*per, F.col("key").alias("last"))
    whole = bins.filter("before + n < rest").select(*per, "last")
    return cut(inside.unionByName(whole).groupBy(*per).agg(F.max("last").alias("last")))


def _attached(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows joined to their leaf's cutoffs; those go to all machines only if they are known to be few."""
    few = ends.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(ends) if few else ends, list(LEVELS))


def mix_documents(docs: DataFrame, mix: Mix, keep_text: bool = False) -> DataFrame:
    """One row for each document and epoch taken: doc_id, LEVELS, epoch, tokens, order key; with keep_text, the columns of docs alone."""
    leaf = leaf_columns()
    slim = cut(docs.select("doc_id", *(c.alias(k) for k, c in leaf.items()), tokens_of(F.col("text")).alias("tokens")))
    ends = cutoffs(slim, mix)
    if keep_text:
        held = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", *(c.alias(k) for k, c in leaf.items()))
        return _attached(held, ends).filter(order_key(mix, F.col("epoch")) <= F.col("last")).select("_row.*")
    return _attached(slim, ends).withColumn("order_key", order_key(mix, F.col("epoch"))).filter(F.col("order_key") <= F.col("last")).select("doc_id", *LEVELS, "epoch", "tokens", "order_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), PRODUCTION)


def _case(names: dict, node: str) -> str:
    return "CASE " + " ".join(f"WHEN {node} = '{k}' THEN {v}" for k, v in names.items()) + " ELSE 1 END"


def _fill_sql(source: str, parents: str, node: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    return f"""
  SELECT *, CASE WHEN filled THEN cap ELSE (b - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({by}), 0)) * w // sum(CASE WHEN NOT filled THEN w END) OVER ({by}) END AS budget
  FROM (SELECT *, cap * sum(w) OVER ({by} ORDER BY cap::DOUBLE / w, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= (b - coalesce(sum(cap) OVER ({by} ORDER BY cap::DOUBLE / w, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS filled FROM ({source}))"""


def sql(mix: Mix = PRODUCTION) -> str:
    blanks = r"[\x20\x09-\x0D]+"
    return rf"""
WITH slim AS (
  SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    CASE WHEN substring(md5(coalesce(source, '')), 1, 1) <= '6' THEN 'web' WHEN substring(md5(coalesce(source, '')), 1, 1) <= 'b' THEN 'books' ELSE 'forum' END AS domain,
    len(list_filter(string_split_regex(coalesce(text, ''), '{blanks}'), lambda x: x <> '')) AS tokens
  FROM documents),
leaves AS (SELECT domain, language, origin, sum(tokens)::HUGEINT AS tokens FROM slim GROUP BY ALL HAVING sum(tokens) > 0),
top AS ({_fill_sql(f"SELECT *, least(sum(t) OVER () * {mix.share[0]} // {mix.share[1]}, sum(cap) OVER ())::HUGEINT AS b FROM (SELECT domain, sum(tokens)::HUGEINT AS t, (sum(tokens) * {mix.epochs})::HUGEINT AS cap, {_case(mix.domain, 'domain')} AS w FROM leaves GROUP BY domain)", "", "domain")}),
mid AS ({_fill_sql(f"SELECT l.*, t.budget::HUGEINT AS b FROM (SELECT domain, language, (sum(tokens) * {mix.epochs})::HUGEINT AS cap, {_case(mix.language, 'language')} AS w FROM leaves GROUP BY ALL) l JOIN top t USING (domain)", "domain", "language")}),
low AS ({_fill_sql(f"SELECT l.*, m.budget::HUGEINT AS b FROM (SELECT *, (tokens * {mix.epochs})::HUGEINT AS cap, {_case(mix.origin, 'origin')} AS w FROM leaves) l JOIN mid m USING (domain, language)", "domain, language", "origin")}),
keyed AS (
  SELECT s.*, e.epoch, md5('{mix.seed}:' || e.epoch || ':' || coalesce(s.doc_id::VARCHAR, '')) AS order_key,
    least(greatest(l.budget - e.epoch * l.tokens, 0), l.tokens) AS rest
  FROM slim s JOIN low l USING (domain, language, origin) CROSS JOIN (SELECT unnest(range({mix.epochs}))::INTEGER AS epoch) e),
run AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin, epoch ORDER BY order_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(tokens) OVER (PARTITION BY domain, language, origin, epoch, order_key) AS ahead FROM keyed)
SELECT doc_id, domain, language, origin, epoch, tokens, order_key FROM run WHERE ahead < rest
"""
