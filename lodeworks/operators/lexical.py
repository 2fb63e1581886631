"""Weighted sparse search (BM25) over an index of impact-ordered postings in blocks, with upper bounds.

A posting's impact is its whole share of a score, from integer statistics (documents, words, documents of a token, its
number in the document). Postings of a token are dealt to parts by hash of the document, so a common token is no
one task's; in a part they are ordered by impact and cut into blocks of BLOCK, each with its largest impact.

A search scores few of the documents that share a token with a query:
1. The first blocks of all of a query's tokens give partial scores, whose k-th is a floor of the k-th score.
2. Tokens are ordered by their largest impact. Those whose sum stays below the floor are inessential: no document
   that has only these can be found. Of the others a block counts if its bound and all other tokens' bounds reach the floor.
3. Documents in these blocks are candidates, unless their essential impacts and the bounds of all inessential tokens
   stay below the floor. Only candidates are scored, from their own postings.
The result is that of scoring every document (scores rounded to 6 digits, ties to the smaller doc_id).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.models import sparse_weights
from lodeworks.operators import terms
from lodeworks.operators.retrieval import INTEGERS, SALTS, few
from lodeworks.operators.shared import written

K1, B = 1.2, 0.75
#: Postings of a block, and of a part, about.
BLOCK, PART = 128, 100_000
#: Scores are rounded to 6 digits; bounds give way by more than that and than floating point errs.
SLACK = 2e-6


def met(rows: DataFrame, small: DataFrame, key: str = "token") -> DataFrame:
    """rows join small on a key that many rows may share: small goes to all machines if it is known to be short, else each key is dealt to SALTS parts."""
    if few(small):
        return rows.join(F.broadcast(small), key)
    salted = small.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def bm25_impact(tf: Column, size: Column, df: Column, docs: int, words: int) -> Column:
    idf = F.log(1 + (F.lit(float(docs)) - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size * F.lit(float(docs)) / F.lit(float(words))))


class LexicalIndex:
    """postings (token, part, block, doc_id, impact), blocks (token, part, block, most, n), tokens (token, df, most)."""

    def __init__(self, postings: DataFrame, blocks: DataFrame, tokens: DataFrame):
        self.postings, self.blocks, self.tokens = postings, blocks, tokens


def query_tokens(queries: DataFrame) -> DataFrame:
    """queries: query_id, text -> distinct query_id, token."""
    return queries.filter(F.col("query_id").isNotNull()).select("query_id", F.explode(F.map_keys(sparse_weights(F.col("text")))).alias("token")).distinct()


def build(docs: DataFrame, asked: DataFrame | None = None) -> LexicalIndex:
    """docs: doc_id, text; of tokens in `asked` alone where it is given. Statistics are those of all documents."""
    named = docs.filter(F.col("doc_id").isNotNull())
    words = F.size(F.array_remove(F.split(F.lower("text"), r"[^\p{L}0-9]+"), "")).cast("long")
    total, count = named.select(words.alias("n")).filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = named.select("doc_id", words.alias("size"), F.explode(sparse_weights(F.col("text"))).alias("token", "tf"))
    if asked is not None:
        rows = met(rows, asked.select("token").distinct())
    rows = written(rows)
    tokens = written(rows.groupBy("token").agg(F.count("*").alias("df")).withColumn("parts", F.ceil(F.col("df") / PART).cast("int")))
    scored = met(rows, tokens).withColumn("impact", bm25_impact(F.col("tf"), F.col("size"), F.col("df"), count, max(1, total)))
    scored = scored.select("token", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", "impact")
    w = Window.partitionBy("token", "part").orderBy(F.desc("impact"), "doc_id")
    postings = written(scored.withColumn("block", F.floor((F.row_number().over(w) - 1) / BLOCK).cast("int")))
    blocks = written(postings.groupBy("token", "part", "block").agg(F.max("impact").alias("most"), F.count("*").alias("n")))
    most = blocks.groupBy("token").agg(F.max("most").alias("most"))
    return LexicalIndex(postings, blocks, written(tokens.select("token", "df").join(most, "token")))


def floors(asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """query_id, floor: the k-th of partial scores from each token's first blocks; 0 where fewer documents are in them."""
    first = met(index.postings.filter("block = 0").select("token", "doc_id", "impact"), asked)
    partial = first.groupBy("query_id", "doc_id").agg(F.sum("impact").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = partial.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    return asked.select("query_id").distinct().join(kth, "query_id", "left").select("query_id", F.coalesce("floor", F.lit(0.0)).alias("floor"))


def weighed(asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """asked (query_id, token) with the token's bound `most`, those of all tokens (`whole`) and of inessential ones (`idle`), floor, and essential."""
    rows = met(asked, index.tokens.select("token", "most")).join(floors(asked, index, k), "query_id")
    by = Window.partitionBy("query_id")
    rows = rows.withColumn("whole", F.sum("most").over(by)).withColumn("upto", F.sum("most").over(by.orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("essential", F.col("upto") >= F.col("floor") - SLACK)
    return rows.withColumn("idle", F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("most"))).over(by)).drop("upto")


def needed_blocks(rows: DataFrame, index: LexicalIndex) -> DataFrame:
    """Blocks (token, part, block) that a query must look into: query_id, floor, idle beside them."""
    essential = rows.filter("essential").select("token", "query_id", "floor", "idle", (F.col("whole") - F.col("most")).alias("others"))
    return met(index.blocks, essential).filter(F.col("most") + F.col("others") >= F.col("floor") - SLACK).select("token", "part", "block", "query_id", "floor", "idle")


def bm25_top_k(queries: DataFrame, index: LexicalIndex, k: int = 20) -> DataFrame:
    """queries: query_id, text -> query_id, doc_id, score, rank. The index holds all tokens of the queries that documents have."""
    asked = written(query_tokens(queries))
    rows = written(weighed(asked, index, k))
    found = index.postings.join(needed_blocks(rows, index), ["token", "part", "block"])
    cand = found.groupBy("query_id", "doc_id").agg(F.sum("impact").alias("got"), F.first("floor").alias("floor"), F.first("idle").alias("idle"))
    cand = cand.filter(F.col("got") + F.col("idle") >= F.col("floor") - SLACK).select("query_id", "doc_id")
    # a candidate's own postings: one row for each token of the query
    pairs = cand.join(rows.select("query_id", "token"), "query_id").join(index.postings.select("token", "doc_id", "impact"), ["token", "doc_id"])
    scores = pairs.groupBy("query_id", "doc_id").agg(F.round(F.sum("impact"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


class Impact:
    """bm25_impact over arrays: of tokens by number, with the documents of each."""

    def __init__(self, df: np.ndarray, docs: int, words: int):
        self.idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
        self.docs, self.words = float(docs), float(max(1, words))

    def __call__(self, token: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf[token] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size * self.docs / self.words))


def bm25_batch(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """queries: query_id, text; docs: doc_id, text -> query_id, doc_id, score, rank, for one batch of queries without an index.

    One pass counts the asked tokens of every document, a second adds up scores where the documents are. Batches beyond
    `terms.LOCAL` tokens, and ids that repeat or are no integers, go through an index.
    """
    tokens = query_tokens(queries)
    asked = terms.local_queries(tokens)
    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    whole = {df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (docs, "doc_id"))} <= set(INTEGERS)
    if asked is None or not whole or terms.split_off(named)[1] is not None:
        return bm25_top_k(queries, build(docs, tokens), k)
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}0-9]+"), "")
    held = terms.counted(named.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")), asked)
    count, total = held.filter("size > 0").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    df = np.zeros(len(asked.tokens))
    for r in held.select(F.explode("tokens").alias("token")).groupBy("token").count().collect():
        df[r["token"]] = r["count"]
    found = terms.weighed(held, asked, Impact(df, count, total), k, 6)
    return found.select(F.col("query_id").cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score", "rank")
