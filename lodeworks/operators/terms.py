"""The best documents of each query by terms in common, scored where the documents are.

The queries' terms go to all machines (few are needed for that: see LOCAL), so a task adds up the scores of its own
documents, some at a time, and hands on the k best of each query alone: pairs of a query and a document are never
shuffled, grouped or sorted. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.shared import bounded_batches, written

#: Rows (query, token) up to which the queries go to all machines; scores and single additions that a task holds at a time.
LOCAL, CELLS, ADDED = 100_000, 1_000_000, 2_000_000


class Asked:
    """Distinct queries and tokens of (query_id, token) rows, and the queries of each token."""

    def __init__(self, rows: list):
        self.ids = sorted({r[0] for r in rows})
        self.tokens = sorted({r[1] for r in rows})
        q, t = {x: i for i, x in enumerate(self.ids)}, {x: i for i, x in enumerate(self.tokens)}
        pairs = sorted((t[r[1]], q[r[0]]) for r in rows)
        self.queries = np.array([x[1] for x in pairs], np.int64)
        self.start = np.searchsorted(np.array([x[0] for x in pairs], np.int64), np.arange(len(self.tokens) + 1))
        self.many = np.diff(self.start)

    def places(self, flat: pa.Array) -> np.ndarray:
        """The number of each token, -1 where no query has it."""
        return pc.fill_null(pc.index_in(flat, value_set=pa.array(self.tokens, flat.type)), -1).to_numpy(zero_copy_only=False)


def local_queries(queries: DataFrame) -> Asked | None:
    """query_id, token as Asked; None where there are too many for all machines."""
    found = queries.filter(F.col("query_id").isNotNull() & F.col("token").isNotNull()).select("query_id", "token").distinct().limit(LOCAL + 1).collect()
    return Asked(found) if len(found) <= LOCAL else None


def lists(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Length of each list of a column (0 for null) and all items in a row."""
    return pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(col)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q, self.ids, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.low, self.last = np.zeros(queries), np.full(queries, np.iinfo(np.int64).min)

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        """ids of documents, s: their scores by queries; 0 is no score."""
        d, q = np.nonzero((s > self.low) | ((s == self.low) & (s > 0) & (ids[:, None] < self.last)))
        if not len(d):
            return
        q, ids, s = np.concatenate([self.q, q]), np.concatenate([self.ids, ids[d]]), np.concatenate([self.s, s[d, q]])
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.ids, self.s, rank = q[keep], ids[keep], s[keep], rank[keep]
        full = rank == self.k - 1
        self.low[self.q[full]], self.last[self.q[full]] = self.s[full], self.ids[full]


def add_up(best: Best, asked: Asked, ids: np.ndarray, doc: np.ndarray, token: np.ndarray, weight: np.ndarray | None, digits: int | None) -> None:
    """Scores of documents `ids` from their tokens (ascending place of the document, number of the token, its weight or 1)."""
    n = len(asked.ids)
    upto = np.cumsum(np.bincount(doc, asked.many[token], len(ids)))
    first = 0
    while first < len(ids):
        before = upto[first - 1] if first else 0
        end = int(min(max(first + 1, np.searchsorted(upto, before + ADDED)), first + max(1, CELLS // max(1, n))))
        a, b = np.searchsorted(doc, [first, end])
        t = token[a:b]
        many = asked.many[t]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(asked.start[t], many)
        cell = np.repeat((doc[a:b] - first) * n, many) + asked.queries[at]
        s = np.bincount(cell, None if weight is None else np.repeat(weight[a:b], many), (end - first) * n).reshape(end - first, n).astype(np.float64)
        best.add(ids[first:end], s if digits is None else np.round(s, digits))
        first = end


def _told(best: Best, asked: Asked, schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array([asked.ids[i] for i in best.q], schema.field(0).type), pa.array(best.ids, pa.int64()), pa.array(best.s, pa.float64())], schema=schema)


_OUT = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlap(docs: DataFrame, asked: Asked, k: int) -> DataFrame:
    """docs: doc_id (long, one row each), words (array<string>, distinct) -> query_id, doc_id, score, rank by the number of words in common."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def score(batches):
        a = shared.value
        best = Best(len(a.ids), k)
        for batch in batches:
            size, flat = lists(batch.column(1))
            token = a.places(flat)
            doc = np.repeat(np.arange(len(size)), size)[token >= 0]
            add_up(best, a, batch.column(0).to_numpy(zero_copy_only=False), doc, token[token >= 0], None, None)
        yield _told(best, a, _OUT)

    found = docs.select("doc_id", "words").mapInArrow(score, "query_id long, doc_id long, score double")
    return ranked(found.withColumn("score", F.col("score").cast("long")), k)


def counted(docs: DataFrame, asked: Asked) -> DataFrame:
    """docs: doc_id, words (array<string>, with repeats) -> doc_id, size (of all words), tokens and tf (arrays of asked tokens), as a table."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("tokens", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def count(batches):
        a = shared.value
        for batch in batches:
            size, flat = lists(batch.column(1))
            token = a.places(flat)
            doc = np.repeat(np.arange(len(size)), size)[token >= 0]
            key, tf = np.unique(doc * max(1, len(a.tokens)) + token[token >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(size) + 1) * max(1, len(a.tokens))), pa.int32())
            held = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % max(1, len(a.tokens)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *held], schema=schema)

    return written(docs.select("doc_id", "words").mapInArrow(count, "doc_id long, size long, tokens array<int>, tf array<int>"))


def weighed(held: DataFrame, asked: Asked, weight, k: int, digits: int) -> DataFrame:
    """held: as counted() gives it; weight(token, tf, size): arrays -> each token's share of a score. query_id, doc_id, score, rank."""
    bounded_batches(held.sparkSession)
    shared = held.sparkSession.sparkContext.broadcast((asked, weight))

    def score(batches):
        a, share = shared.value
        best = Best(len(a.ids), k)
        for batch in batches:
            many, token = lists(batch.column(2))
            token, tf = token.to_numpy(zero_copy_only=False), lists(batch.column(3))[1].to_numpy(zero_copy_only=False)
            size = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), many)
            add_up(best, a, batch.column(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(many)), many), token, share(token, tf, size), digits)
        yield _told(best, a, _OUT)

    return ranked(held.mapInArrow(score, "query_id long, doc_id long, score double"), k)


def split_off(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(docs whose doc_id is one row's alone, the others or None): only the first can be scored row by row."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | F.col("doc_id").isNull()).select("doc_id")
    if ids.isEmpty():
        return docs, None
    ids = written(ids)
    same = docs["doc_id"].eqNullSafe(ids["doc_id"])
    return docs.join(ids, same, "left_anti"), docs.join(ids, same, "left_semi")
