"""Centroid clustering (Lloyd's rounds on integers) with block-norm screening of centroids.

1. Vectors become integers and are packed once into blocks of at most BLOCK rows, with their compressed form: for each
   SEGMENT components their sum and the norm of what is left of them without their mean.
2. By Cauchy-Schwarz the inner product of two segments is at most (sum * sum) / SEGMENT + norm * norm, so
   |x|^2 + |c|^2 - 2 * (all segments' bounds) is a lower bound of the squared distance, from the compressed forms alone.
3. In each round a vector meets its centroids in the order of that bound. The first gets an exact distance in integers, the
   next ones too while their bound is no larger than the least distance so far; all others are screened off.
   Bounds are in floating point and carry a slack, distances are exact.
4. A task adds up its vectors by centroid; Spark sums these, and the driver gets one row for each centroid and
   component. No shuffle moves vectors, and lost tasks are repeated from the packed table.

Defined results: vectors that are null, have not exactly `dim` components or hold null or non-finite ones take no
part, nor do rows without vec_id; rows that repeat a vec_id are vectors of their own (of equal hash, the smaller components start first);
ties go to the smaller centroid; empty centroids stay; fewer vectors than centroids make one centroid each; components
saturate at +-2^62 and distances and their sums at 2^63 - 1; an empty table gives an empty one; other columns aren't
read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table

#: Components of a segment, rows of a block at most.
SEGMENT, BLOCK = 4, 4096
_MOST, _LONG = 2**62, 2**63 - 1
#: Components up to which distances fit 64 bits, for up to 64 components.
_SAFE = 2**27


def quantised(vectors: DataFrame, vec_id: str, vec: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v array<bigint> of floor(scale * x) for vectors that take part."""
    x = F.col(vec)
    ok = x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    clip = lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(_MOST)), F.lit(-_MOST))
    return vectors.filter(ok & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, clip).alias("v"))


def compressed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors (one a row) -> their compressed form, so that products of forms bound inner products, and their squared norms."""
    y = x.astype(np.float64)
    if y.shape[1] % SEGMENT:
        y = np.hstack([y, np.zeros((len(y), -y.shape[1] % SEGMENT))])
    y = y.reshape(len(y), -1, SEGMENT)
    mean = y.mean(2, keepdims=True)
    rest = np.sqrt(((y - mean) ** 2).sum(2))
    return np.hstack([mean[:, :, 0] * np.sqrt(SEGMENT), rest]), (y * y).sum((1, 2))


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact; beyond 2^63 - 1 that."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _SAFE and x.shape[1] <= 64:
        d = x - c
        return (d * d).sum(1)
    d = x.astype(object) - c.astype(object)
    return np.minimum((d * d).sum(1), _LONG).astype(np.int64)


def nearest(x: np.ndarray, form: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller), its exact distance, and how many exact distances it took."""
    cform, cnorm = compressed(centroids)
    size = norm[:, None] + cnorm[None]
    bound = size * (1 - 1e-6) - 2 * form @ cform.T - 1
    order = np.argsort(bound, axis=1, kind="stable")
    best, near = np.full(len(x), _LONG, np.int64), np.zeros(len(x), np.int64)
    rows, taken = np.arange(len(x)), 0
    for r in range(len(centroids)):
        c = order[rows, r]
        if r:
            ok = bound[rows, c] <= best[rows]
            rows, c = rows[ok], c[ok]
            if not len(rows):
                break
        d = _exact(x[rows], centroids[c])
        taken += len(rows)
        good = (d < best[rows]) | ((d == best[rows]) & ((c < near[rows]) | (r == 0)))
        best[rows[good]], near[rows[good]] = d[good], c[good]
    return near, best, taken


_PACKED = pa.schema([("ids", pa.binary()), ("mat", pa.binary()), ("form", pa.binary()), ("norm", pa.binary())])


def _packer(dim: int):
    def pack(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            for a in range(0, len(ids), BLOCK):
                form, norm = compressed(x[a : a + BLOCK])
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (ids[a : a + BLOCK], x[a : a + BLOCK], form, norm)], schema=_PACKED)

    return pack


def _unpacked(batch: pa.RecordBatch, dim: int):
    for ids, mat, form, norm in zip(*(c.to_pylist() for c in batch.columns)):
        n = len(ids) // 8
        yield np.frombuffer(ids, np.int64), np.frombuffer(mat, np.int64).reshape(n, dim), np.frombuffer(form).reshape(n, -1), np.frombuffer(norm)


_SUMS = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0))])


def _adder(dim: int, centroids: np.ndarray):
    """Blocks become a task's sums of components by cluster; place -1 holds the number of vectors."""

    def add(batches):
        sums = np.zeros((len(centroids), dim), object)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x, form, norm in _unpacked(batch, dim):
                near = nearest(x, form, norm, centroids)[0]
                for k in np.unique(near).tolist():
                    mine = x[near == k]
                    part = mine.sum(0) if np.abs(mine).max(initial=0) < 2**40 else mine.astype(object).sum(0)
                    sums[k] += part.astype(object)
                    count[k] += len(mine)
        rows = [(k, p, t) for k in np.nonzero(count)[0].tolist() for p, t in [(-1, int(count[k])), *enumerate(int(s) for s in sums[k])]]
        if rows:
            k, p, t = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array([Decimal(v) for v in t], pa.decimal128(38, 0))], schema=_SUMS)

    return add


def _assigner(dim: int, centroids: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches):
        for batch in batches:
            for ids, x, form, norm in _unpacked(batch, dim):
                near, best, _ = nearest(x, form, norm, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.astype(np.int32)), pa.array(best)], schema=schema)

    return assign


def moved(packed: DataFrame, dim: int, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count) of their vectors."""
    sums = packed.mapInArrow(_adder(dim, centroids), "cluster int, place int, total decimal(38,0)")
    found = {(r[0], r[1]): int(r[2]) for r in sums.groupBy("cluster", "place").agg(F.sum("total")).collect()}
    out = centroids.copy()
    for k in range(len(centroids)):
        n = found.get((k, -1), 0)
        if n:
            out[k] = [found[k, p] // n for p in range(dim)]
    return out


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", vec_id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of each vector that takes part, as a table, and the final centroids."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = quantised(vectors, vec_id, vec, dim, scale)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.select(first.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64)
    centroids = np.array([r["v"] for r in start], np.int64)
    packed = cut(kept.mapInArrow(_packer(dim), "ids binary, mat binary, form binary, norm binary"))
    for _ in range(rounds):
        centroids = moved(packed, dim, centroids)
    return cut(packed.mapInArrow(_assigner(dim, centroids), "vec_id long, cluster int, distance long")), centroids


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    held = lambda c: F.least(F.sum(c), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    each = found.groupBy("cluster").agg(held(F.col("distance").cast("decimal(20,0)")).alias("cluster_inertia"))
    whole = found.agg(held(F.col("distance").cast("decimal(20,0)")).alias("inertia"))
    # one row for each centroid
    clusters = each.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster").withColumn("inertia", F.lit(whole.first()[0]).cast("long"))
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(clusters: int = 16, rounds: int = 3) -> str:
    floor = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
    near = "SELECT r, cluster, distance FROM (SELECT r, cluster, distance, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS o FROM (SELECT e.r, c.cluster, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS distance FROM e JOIN {c} c USING (place) GROUP BY e.r, c.cluster)) WHERE o = 1"
    steps = [f"c0 AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k) ORDER BY h, v LIMIT {clusters}))"]
    for i in range(rounds):
        steps.append(f"a{i} AS ({near.format(c=f'c{i}')})")
        steps.append(f"m{i} AS (SELECT cluster, place, {floor} AS x FROM a{i} JOIN e USING (r) GROUP BY cluster, place)")
        steps.append(f"c{i + 1} AS (SELECT cluster, place, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (cluster, place))")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM k),
{", ".join(steps)},
f AS MATERIALIZED ({near.format(c=f"c{rounds}")}),
n AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM f JOIN k USING (r) JOIN n USING (cluster)"""


SQL = _sql()
