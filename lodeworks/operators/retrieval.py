"""Exact cosine retrieval, re-ranking, fusion, context assembly and links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import cosine, link_admissible
from lodeworks.operators import terms

RETRIEVE, RERANK, SINGLE_SHOT, SHOWN_LINKS = 20, 3, 5, 3
#: Rows of the smaller side up to which it is sent to every machine.
BROADCAST_ROWS = 10_000
#: Bytes of query blocks up to which they are sent to every machine; rows of a block.
BROADCAST_BYTES, BLOCK, QUERY_BLOCK = 32_000_000, 2048, 1024
#: Parts of a token's documents where the queries' tokens are too many to be sent to every machine.
SALTS = 32
#: Types of ids that are scored in Python.
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def top_k(vectors: DataFrame, query: Column, k: int = RETRIEVE, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest rows to one vector: a scan and a top-k a partition, merged (TakeOrderedAndProject)."""
    return vectors.select(F.col(vec_id).alias("vec_id"), F.round(cosine(F.col(vec), query), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, vec) as blocks of at most `size`: ids, vectors scaled to length 1 (zeros stay), and their dimension. No shuffle."""

    def pack(batches):
        for pdf in batches:
            pdf = pdf[pdf["vec"].notna() & pdf["id"].notna()]
            for dim, part in pdf.groupby(pdf["vec"].map(len)):
                for at in range(0, len(part), size):
                    some = part.iloc[at : at + size]
                    x = np.stack(some["vec"].tolist()).astype(np.float64) if dim else np.zeros((len(some), 0))
                    norm = np.sqrt((x * x).sum(1, keepdims=True))
                    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                    yield pd.DataFrame({"ids": [some["id"].to_numpy(np.int64).tobytes()], "mat": [unit.tobytes()], "dim": [int(dim)]})

    return rows.mapInPandas(pack, "ids binary, mat binary, dim int")


def top_k_batch(queries: DataFrame, vectors: DataFrame, k: int = RETRIEVE, exclude_own: bool = False) -> DataFrame:
    """queries: query_id, query_vec; vectors: vec_id, embedding. Ranks by cosine, ties to the smaller id; vectors of one dimension meet.

    The stated queries meet all rows in blocks, a product of matrices for each two; a pair of blocks hands on the k
    best of each query alone. Blocks of queries go to all machines, BROADCAST_BYTES of them at a time by their
    counted size, so more queries are more passes over the vectors.
    """
    held = _packed(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")), BLOCK)
    size = queries.agg(F.coalesce(F.sum(F.size("query_vec").cast("long") * 8 + 8), F.lit(0))).first()[0]
    waves = max(1, -(-size // BROADCAST_BYTES))

    def score(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                qids, ids = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                s = np.round(np.frombuffer(r.qmat).reshape(len(qids), -1) @ np.frombuffer(r.mat).reshape(len(ids), -1).T, 6) + 0.0
                if exclude_own:
                    s[qids[:, None] == ids[None, :]] = -2.0
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                ok = best > -2.0
                yield pd.DataFrame({"query_id": np.repeat(qids, ok.sum(1)), "vec_id": ids[order][ok], "score": best[ok]})

    scored = None
    for wave in range(waves):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(waves)) == wave).select(F.col("query_id").cast("long").alias("id"), F.col("query_vec").alias("vec"))
        asked = _packed(some, QUERY_BLOCK).select(F.col("ids").alias("qids"), F.col("mat").alias("qmat"), "dim")
        found = held.join(F.broadcast(asked), "dim").mapInPandas(score, "query_id long, vec_id long, score double")
        scored = found if scored is None else scored.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tokens(docs: DataFrame, doc_id: str, text: str, least: int = 1) -> DataFrame:
    """Distinct tokens of each text: letters and digits of any script in a row."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}0-9]+"))
    return docs.select(F.col(doc_id).alias(doc_id), F.explode(words).alias("token")).filter(F.length("token") >= least)


def term_overlap(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank by the number of tokens in common: an inverted-list join on token.

    The queries' tokens go to all machines if they are known to be few; else each token is dealt to SALTS parts by
    document, so that a common one brings no task all documents.
    """
    if few(queries):
        joined = docs.join(F.broadcast(queries), "token")
    else:
        salted = queries.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["token", "_salt"])
    hits = joined.groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlap_top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """queries: query_id, token; docs: doc_id, text -> query_id, doc_id, score, rank by the number of distinct tokens in common.

    Scored where the documents are, so that no pair of query and document is shuffled; queries beyond `terms.LOCAL`, and
    documents that have no doc_id or share it, go by term_overlap, the join on tokens.
    """
    asked = terms.local_queries(queries)
    if asked is None or docs.schema["doc_id"].dataType.simpleString() not in INTEGERS or queries.schema["query_id"].dataType.simpleString() not in INTEGERS:
        return term_overlap(queries.distinct(), tokens(docs, "doc_id", "text").distinct(), k)
    alone, rest = terms.split_off(docs.select("doc_id", "text"))
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}0-9]+"))
    found = terms.overlap(alone.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_remove(words, "").alias("words")), asked, k)
    if rest is not None:
        found = terms.ranked(found.drop("rank").unionByName(term_overlap(queries.distinct(), tokens(rest, "doc_id", "text").distinct(), k).drop("rank")), k)
    return found.withColumns({"query_id": F.col("query_id").cast(queries.schema["query_id"].dataType), "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType)})


def rerank(retrieved: DataFrame, score: Column, n: int = RERANK) -> DataFrame:
    """retrieved: query_id, rank and payload. Up to n rows keep their order; more are ordered by score, ties by rank."""
    by = Window.partitionBy("query_id")
    df = retrieved.withColumn("_n", F.count("*").over(by)).withColumn("_score", F.when(F.col("_n") > n, score))
    w = by.orderBy(F.desc_nulls_last("_score"), "rank")
    return df.withColumn("rerank", F.row_number().over(w)).filter(F.col("rerank") <= n).drop("_n", "_score")


def reciprocal_rank_fusion(one: DataFrame, two: DataFrame, k: int, c: int = 60) -> DataFrame:
    both = one.select("query_id", "doc_id", "rank").unionByName(two.select("query_id", "doc_id", "rank"))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.col("rank") + c)), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def assemble_context(ranked: DataFrame, text: str = "text", rank: str = "rank") -> DataFrame:
    """query_id, context: numbered texts in the order of rank."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("["), p["r"].cast("string"), F.lit("] "), p["t"])), "\n\n").alias("context"))


def source_links(links: Column, most: int = SHOWN_LINKS) -> Column:
    """The first admissible, distinct links of an array, in order of appearance."""
    return F.slice(F.array_distinct(F.filter(links, link_admissible)), 1, most)
