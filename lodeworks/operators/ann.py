"""Approximate nearest neighbours by cosine: an inverted file over coarse centroids with residual product codes.

Fitting reads at most SAMPLE rows (those with the smallest hashes of their ids): coarse centroids by k-means on
vectors of length 1, codebooks of what is left of a vector without its centroid, one for each of `parts` slices, and
`probes`, the number of lists within which the sample's own neighbours lie for the recall aimed at.

The index holds every row: its list, a code of one byte a slice, and the vector. A list is split by hash of the id
into parts of about PART rows, so no list is one task's, however many vectors it draws; queries go to all parts of the
lists they probe. In a part a query scores codes by table look-up, takes the `refine` * k best, scores those exactly and
hands on k rows. Vectors aren't moved for a search, only k rows a part and query are.

Results are exact for the candidates looked at; `probes` = all lists and `refine` = None look at all, and are exact.
Rows whose id or vector is null, or whose dimension isn't the index's, take no part; zero vectors score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.shared import written

#: Rows that centroids and codebooks are fitted on, at most; rows of a part of a list, about; queries of a block.
SAMPLE, PART, QUERY_BLOCK = 20_000, 8192, 512
#: Entries of a codebook at most (a byte), components of a slice, steps of k-means.
CODES, SLICE, STEPS = 256, 4, 8


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def k_means(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """Centroids of the rows of x; one that draws none is set on the row farthest from its own."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = _closest(x, c)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        far = iter(np.argsort(-((x - c[near]) ** 2).sum(1), kind="stable"))
        for j in range(k):
            c[j] = sums[j] / count[j] if count[j] else x[next(far)]
    return c


@dataclass
class Quantiser:
    centroids: np.ndarray
    books: list[np.ndarray]
    bounds: list[tuple[int, int]]
    probes: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors -> their list and their codes."""
        at = _closest(x, self.centroids)
        rest = x - self.centroids[at]
        return at, np.stack([_closest(rest[:, a:b], book) for (a, b), book in zip(self.bounds, self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each slice the products of the queries with all code words."""
        return [q[:, a:b] @ book.T for (a, b), book in zip(self.bounds, self.books)]

    def lists_of(self, q: np.ndarray, probes: int) -> np.ndarray:
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        return order[:, : min(probes, len(self.centroids))]


def fit(sample: np.ndarray, lists: int | None = None, slice_: int = SLICE, recall: float = 0.97, k: int = 20) -> Quantiser:
    """sample: rows of one dimension. lists: about the root of the rows where it isn't given."""
    x = _unit(sample.astype(np.float64))
    centroids = k_means(x, lists or max(1, int(len(x) ** 0.5)))
    rest = x - centroids[_closest(x, centroids)]
    bounds = [(a, min(a + slice_, x.shape[1])) for a in range(0, x.shape[1], slice_)]
    books = [k_means(rest[:, a:b], CODES) for a, b in bounds]
    q = Quantiser(centroids, books, bounds, len(centroids))
    # How many lists, by rank for the query, hold the neighbours of some of the sample's rows.
    asked = x[:: max(1, len(x) // 256)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    rank = np.empty((len(asked), len(centroids)), np.int64)
    np.put_along_axis(rank, q.lists_of(asked, len(centroids)), np.arange(len(centroids))[None], 1)
    found = np.sort(np.take_along_axis(rank, _closest(x, centroids)[near], 1).ravel())
    q.probes = int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1
    return q


class AnnIndex:
    """quantiser, blocks (list, part, ids, codes, mat: a row a part) and parts (list, parts: a row a list)."""

    def __init__(self, quantiser: Quantiser, blocks: DataFrame, parts: DataFrame, dim: int, kind: type):
        self.quantiser, self.blocks, self.parts, self.dim, self.kind = quantiser, blocks, parts, dim, kind


def build(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", lists: int | None = None, recall: float = 0.97) -> AnnIndex | None:
    """An index of all rows; None for a table without vectors."""
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    rows = rows.filter(~F.exists("vec", lambda c: c.isNull() | F.isnan(c)))
    # ids alone are ordered for the sample; its vectors are fetched after
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = [r["vec"] for r in rows.join(F.broadcast(chosen), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not sample:
        return None
    dim = len(sample[0])
    quantiser = fit(np.array([v for v in sample if len(v) == dim]), lists, recall=recall)
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                at, codes = shared.value.encode(_unit(np.stack(pdf["vec"].tolist())))
                yield pd.DataFrame({"id": pdf["id"], "list": at.astype(np.int32), "code": [c.tobytes() for c in codes], "vec": pdf["vec"]})

    coded = written(rows.filter(F.size("vec") == dim).mapInPandas(assign, "id long, list int, code binary, vec array<double>"))
    parts = written(coded.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))

    kind = np.float32 if vectors.schema[vec].dataType.elementType.typeName() == "float" else np.float64

    def pack(key, pdf):
        pdf = pdf.sort_values("id")  # so that equal codes leave the smaller ids among the candidates
        mat = np.stack(pdf["vec"].tolist()).astype(kind)
        return pd.DataFrame({"list": [key[0]], "part": [key[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "codes": [b"".join(pdf["code"])], "mat": [mat.tobytes()]})

    # a row a list, of which there are at most SAMPLE
    dealt = coded.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    blocks = written(dealt.groupBy("list", "part").applyInPandas(pack, "list int, part int, ids binary, codes binary, mat binary"))
    return AnnIndex(quantiser, blocks, parts, dim, kind)


def search(index: AnnIndex, queries: DataFrame, k: int = 20, probes: int | None = None, refine: int | None = 8) -> DataFrame:
    """queries: query_id, query_vec -> query_id, vec_id, score, rank; ties to the smaller id. probes: lists a query looks
    into (the index's own where it is None); refine: how many times k candidates of a part are scored exactly, None: all."""
    q = index.quantiser
    probes = probes or q.probes
    shared = queries.sparkSession.sparkContext.broadcast(q)
    asked = queries.filter(F.col("query_id").isNotNull() & (F.size("query_vec") == index.dim)).select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("query_vec"))
    asked = asked.filter(~F.exists("query_vec", lambda c: c.isNull() | F.isnan(c)))

    def probe(batches):
        for pdf in batches:
            if len(pdf):
                unit = _unit(np.stack(pdf["query_vec"].tolist()))
                at = shared.value.lists_of(unit, probes)
                n = at.shape[1]
                yield pd.DataFrame({"list": at.ravel().astype(np.int32), "query_id": np.repeat(pdf["query_id"].to_numpy(), n), "unit": [u.tobytes() for u in unit for _ in range(n)]})

    probed = asked.mapInPandas(probe, "list int, query_id long, unit binary")
    # A query goes to every part of a list; blocks of queries keep a part's partners few.
    sent = probed.join(F.broadcast(index.parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = queries.count()
    sent = sent.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-many // QUERY_BLOCK)))))
    packed = sent.groupBy("list", "part", "qblock").agg(F.collect_list(F.struct("query_id", "unit")).alias("asked"))
    dim, kind = index.dim, index.kind

    def score(batches):
        quantiser = shared.value
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1)
                mat = np.frombuffer(r.mat, kind).reshape(len(ids), dim)
                qids = np.array([a["query_id"] for a in r.asked], np.int64)
                unit = np.stack([np.frombuffer(a["unit"]) for a in r.asked])
                take = len(ids) if refine is None else min(len(ids), refine * k)
                if take < len(ids):
                    near = np.repeat((unit @ quantiser.centroids[r.list])[:, None], len(ids), 1)
                    for m, table in enumerate(quantiser.tables(unit)):
                        near += table[:, codes[:, m]]
                    cand = np.argsort(-near, axis=1, kind="stable")[:, :take]
                    exact = np.stack([u @ _unit(mat[c].astype(np.float64)).T for u, c in zip(unit, cand)])
                else:
                    cand = np.broadcast_to(np.arange(len(ids)), (len(qids), len(ids)))
                    exact = unit @ _unit(mat.astype(np.float64)).T
                exact = np.round(exact, 6) + 0.0
                order = np.lexsort((ids[cand], -exact), axis=1)[:, :k]
                best = np.take_along_axis(cand, order, 1)
                yield pd.DataFrame({"query_id": np.repeat(qids, order.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(exact, order, 1).ravel()})

    hits = index.blocks.join(packed, ["list", "part"]).mapInPandas(score, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth's (query_id, vec_id) that found holds."""
    keys = ["query_id", "vec_id"]
    whole = truth.select(*keys).distinct()
    return found.select(*keys).distinct().join(whole, keys).count() / max(1, whole.count())
