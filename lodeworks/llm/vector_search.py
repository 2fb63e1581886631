"""Exact top-k by inner product through a pivot-distance index.

Inner products become distances by one more component: a vector x gets sqrt(M - |x|^2), M the largest
squared norm, a query gets 0; then |q - x|^2 = |q|^2 + M - 2 q.x. Each vector is keyed by its nearest
pivot and the distance to it. A pivot's distances are cut into annuli, an annulus into blocks of about
BLOCK rows by hash of the id, so that neither a hot pivot nor equal vectors make a large block.

Queries go in blocks too. For a query and an annulus [lo, hi] around p the triangle inequality gives
|q - x| >= max(|q - p| - hi, lo - |q - p|). Annuli are expanded in the order of that bound, in rounds;
after a round each query's k-th score gives the radius beyond which no annulus can add to its result,
and the search stops when none is left. All scores are integers and exact; bounds carry a slack.

Pivots are fitted on at most SAMPLE vectors (those with the smallest hashes of ids, which alone are ordered);
any pivots give exact results. What comes to the driver: pivots, and a row for each annulus (PIVOTS * ANNULI at most).

Defined results: vectors null or holding null or non-finite components take no part; of vectors of different
lengths the missing components count as 0, so an empty one has score 0 with all; ties go to the smaller id; components saturate
at +-2^62 and scores at +-(2^63 - 2), beyond which a long holds no score; repeated ids are separate candidates, and all query rows of one id, equal or not, are one
query: its result is the k highest scores of any of them, a candidate counting once for each row, as in SQL;
an empty table gives an empty one; columns beyond id and vector aren't read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SAMPLE, PIVOTS, ANNULI = 2048, 32, 16
BLOCK, QUERY_BLOCK = 4096, 512
#: Annuli expanded by the end of each round; the last round takes all that are left.
ROUNDS = (1, 4, 16, 64, None)
#: Tasks that merge partial results of one block of queries before the last one does.
MERGERS = 16
_MOST = 2**62


def quantised(vectors: DataFrame, vec_id: str, vec: str, scale: int) -> DataFrame:
    """vec_id, v array<bigint> of floor(scale * x) for vectors that take part."""
    x = F.col(vec)
    ok = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    clip = lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(_MOST)), F.lit(-_MOST))
    return vectors.filter(ok & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, clip).alias("v"))


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products: in float64 while sums stay below 2^53, else in Python's integers, held within 64 bits."""
    top = lambda a: float(np.abs(a).max(initial=0))
    if top(q) * top(x) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, 2 - 2**63, 2**63 - 2).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def fit_pivots(sample: np.ndarray, count: int, steps: int = 5) -> np.ndarray:
    """Far points first, then a few steps of Lloyd's."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1] :][:1])[:, 0])
    pivots = sample[chosen].copy()
    for _ in range(steps):
        near = _distances(sample, pivots).argmin(1)
        for p in range(len(pivots)):
            if (near == p).any():
                pivots[p] = sample[near == p].mean(0)
    return pivots


def _looked_up(values: list, at: str) -> Column:
    """The entry of a short list at an index from 0."""
    return F.expr(f"element_at(array({', '.join(f'{x!r}D' if isinstance(x, float) else f'{x}L' for x in values)}), cast({at} as int) + 1)")


def _packer(dim: int):
    """Rows sorted by `block` become one row a block: ids and components as bytes."""

    def pack(batches):
        held, key = [], None

        def out(parts):
            ids = np.concatenate([p[0] for p in parts])
            return pd.DataFrame({"block": [key], "ids": [ids.tobytes()], "mat": [np.vstack([p[1] for p in parts]).tobytes()]})

        for pdf in batches:
            for k, g in pdf.groupby("block", sort=True):
                if held and k != key:
                    yield out(held)
                    held = []
                key = k
                held.append((g["vec_id"].to_numpy(np.int64), _matrix(g["v"].tolist(), dim)))
        if held:
            yield out(held)

    return pack


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    return cut(rows.select("block", "vec_id", "v").repartition("block").sortWithinPartitions("block").mapInPandas(_packer(dim), "block long, ids binary, mat binary"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row by (score, smaller id)."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k] if scores.shape[1] <= 4 * k else None
    if order is None:
        # rows beyond the k-th score can't count; ties with it must all be looked at
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        width = int((scores >= kth).sum(1).max())
        front = np.argsort(-scores, axis=1, kind="stable")[:, :width]
        scores, ids = np.take_along_axis(scores, front, 1), np.take_along_axis(ids, front, 1)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


_NONE = np.iinfo(np.int64).max
_LOW = -_NONE


def _searcher(dim: int, k: int):
    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                qids, q = np.frombuffer(r.qids, np.int64), np.frombuffer(r.qmat, np.int64).reshape(-1, dim)
                ids, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.mat, np.int64).reshape(-1, dim)
                scores, who = _dot(q, x), np.broadcast_to(ids, (len(qids), len(ids))).copy()
                own = who == qids[:, None]
                scores[own], who[own] = _LOW, _NONE
                s, i = _best(scores, who, k)
                yield pd.DataFrame({"qb": [r.qb], "scores": [s.tobytes()], "found": [i.tobytes()]})

    return search


def _merger(k: int):
    """Rows sorted by qb: one state a query block."""

    def merge(batches):
        key, state, rows = None, None, 0

        def out():
            return pd.DataFrame({"qb": [key], "n": [rows], "scores": [state[0].tobytes()], "found": [state[1].tobytes()]})

        for pdf in batches:
            for r in pdf.itertuples():
                if key is not None and r.qb != key:
                    yield out()
                    state = None
                key = r.qb
                rows = r.n
                s, i = (np.frombuffer(b, np.int64).reshape(rows, -1) for b in (r.scores, r.found))
                state = (s, i) if state is None else _best(np.hstack([state[0], s]), np.hstack([state[1], i]), k)
        if key is not None:
            yield out()

    return merge


def _pairer(dim: int, k: int, most: float, pivots: np.ndarray, annuli: np.ndarray, first: int, until: int | None):
    """Query blocks with their state become pairs with the blocks of annuli of rank first to until, by bound, that can still count.

    annuli: rows of pivot, lo, hi, first block, blocks.
    """

    def pair(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                q = np.frombuffer(r.qmat, np.int64).reshape(-1, dim).astype(np.float64)
                norm = (q * q).sum(1)
                far = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)[:, annuli[:, 0].astype(int)]
                bound = np.maximum(np.maximum(far - annuli[:, 2], annuli[:, 1] - far), 0)
                radius = np.full(len(q), np.inf)
                if r.scores is not None:
                    s = np.frombuffer(r.scores, np.int64).reshape(len(q), -1)
                    kth = np.where((s.shape[1] >= k) & (s[:, -1] > _LOW), s[:, -1], -np.inf).astype(np.float64)
                    radius = np.sqrt(np.maximum(norm + most - 2 * kth, 0))
                slack = 1e-6 * (1 + np.sqrt(norm + most))
                may = (bound <= (radius + slack)[:, None]).any(0)
                rank = bound.min(0).argsort(kind="stable")[first:until]
                blocks = [b for a in rank if may[a] for b in range(int(annuli[a, 3]), int(annuli[a, 3] + annuli[a, 4]))]
                yield pd.DataFrame({"qb": np.full(len(blocks), r.block, np.int64), "block": np.array(blocks, np.int64)})

    return pair


def exact_topk(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vec: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with every other row."""
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, vec_id, vec, scale))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    dim, most = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if dim is None:
        return spark.createDataFrame([], schema)
    dim = max(dim, 1)
    chosen = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = _matrix([r["v"] for r in rows.join(F.broadcast(chosen), "vec_id", "left_semi").dropDuplicates(["vec_id"]).collect()], dim)
    pivots = fit_pivots(_lifted(sample, most), PIVOTS)

    def keyed(batches):
        for pdf in batches:
            far = _distances(_lifted(_matrix(pdf["v"].tolist(), dim), most), pivots)
            yield pdf.assign(pivot=far.argmin(1).astype(np.int32), dist=far.min(1))

    index = cut(rows.mapInPandas(keyed, "vec_id long, v array<bigint>, pivot int, dist double"))
    reach = {r["pivot"]: r["far"] for r in index.groupBy("pivot").agg(F.max("dist").alias("far")).collect()}
    width = _looked_up([max(reach.get(p, 0), 1e-9) / ANNULI for p in range(len(pivots))], "pivot")
    index = index.withColumn("ring", F.least(F.floor(F.col("dist") / width), F.lit(ANNULI - 1)).cast("int"))
    asked = F.col("vec_id").isNotNull() & is_query
    told = index.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.count(F.when(asked, 1)).alias("nq"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("pivot", "ring").collect()
    annuli, at, qat = [], 0, 0
    starts = [[0, 1, 0, 1] for _ in range(len(pivots) * ANNULI)]
    for r in told:
        blocks, qblocks = -(-r["n"] // BLOCK), -(-r["nq"] // QUERY_BLOCK)
        annuli.append((r["pivot"], r["lo"], r["hi"], at, blocks))
        starts[r["pivot"] * ANNULI + r["ring"]] = [at, blocks, qat, max(qblocks, 1)]
        at, qat = at + blocks, qat + qblocks
    annuli = np.array(annuli, np.float64)
    ring = f"pivot * {ANNULI} + ring"
    first_of = lambda i: _looked_up([x[i] for x in starts], ring) + F.pmod(F.xxhash64(F.lit(5), "vec_id"), _looked_up([x[i + 1] for x in starts], ring))
    blocks = _packed(index.withColumn("block", first_of(0).cast("long")), dim)
    # Every query row is answered, as in SQL; of equal rows more than k can't change the k highest.
    alike = index.filter(asked).groupBy("vec_id", "v").agg(F.min(F.struct("pivot", "dist", "ring")).alias("at"), F.count("*").alias("n"))
    alike = alike.select("vec_id", "v", "at.*", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")).drop("copy")
    queries = _packed(alike.withColumn("block", first_of(2).cast("long")), dim)
    queries = queries.withColumn("n", (F.length("ids") / 8).cast("int"))
    state, first = None, 0
    for until in ROUNDS:
        known = queries.select("block", F.col("mat").alias("qmat"), F.lit(None).cast("binary").alias("scores")) if state is None else queries.select("block", F.col("mat").alias("qmat")).join(state.select(F.col("qb").alias("block"), "scores"), "block")
        pairs = known.mapInPandas(_pairer(dim, k, most, pivots, annuli, first, until), "qb long, block long")
        todo = pairs.join(queries.select(F.col("block").alias("qb"), F.col("ids").alias("qids"), F.col("mat").alias("qmat")), "qb").join(blocks, "block")
        new = todo.mapInPandas(_searcher(dim, k), "qb long, scores binary, found binary")
        new = new if state is None else new.unionByName(state)
        new = new.join(queries.select(F.col("block").alias("qb"), "n"), "qb")
        # in two levels, so that no task gets all partial results of a block of queries
        merged, salt = "qb long, n int, scores binary, found binary", F.pmod(F.xxhash64("found"), F.lit(MERGERS))
        some = new.repartition(F.col("qb"), salt).sortWithinPartitions("qb").mapInPandas(_merger(k), merged)
        state = cut(some.repartition("qb").sortWithinPartitions("qb").mapInPandas(_merger(k), merged).drop("n"))
        first = until
    def answer(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                qids = np.frombuffer(r.ids, np.int64)
                s, i = (np.frombuffer(b, np.int64).reshape(len(qids), -1) for b in (r.scores, r.found))
                ok = i != _NONE
                yield pd.DataFrame({"query_id": np.repeat(qids, ok.sum(1)), "rank": (np.nonzero(ok)[1] + 1).astype(np.int32), "vec_id": i[ok], "score": s[ok]})

    found = state.join(queries.select(F.col("block").alias("qb"), "ids"), "qb").mapInPandas(answer, schema)
    # Rows of one id are one query: the k highest of them all.
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.e) = len(c.e) AND len(q.e) > 0 THEN list_inner_product(q.e, c.e) ELSE coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
