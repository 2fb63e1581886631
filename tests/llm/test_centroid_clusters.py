import hashlib
import math

import numpy as np

from lodeworks.llm import centroid_clusters as cc


def brute(rows, clusters, rounds, dim, seed="1"):
    kept = [(i, [math.floor(64 * float(c)) for c in x]) for i, x in rows if i is not None and x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in start[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        centroids = [[sum(col) // len(g) for col in zip(*g)] if (g := [v for (_, v), m in zip(kept, mine) if m == k]) else c for k, c in enumerate(centroids)]
    return sorted((i, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in kept), centroids


def vectors(seed, n, dim, spots=12):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(spots, dim))
    return [(i, (at[i % spots] + 0.15 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def check(spark, rows, clusters, rounds, dim, kind="float"):
    df = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int")
    found, centroids = cc.cluster(df, clusters, rounds, dim)
    want, last = brute([(i, x) for i, x in rows], clusters, rounds, dim)
    assert centroids.tolist() == last
    assert sorted(tuple(r) for r in found.collect()) == want


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cc, "BLOCK", 50)
    check(spark, vectors(1, 700, 64), 16, 3, 64)
    check(spark, vectors(2, 200, 6), 5, 4, 6)  # a last segment that isn't full


def test_ties_copies_and_those_that_take_no_part(spark):
    rows = vectors(3, 60, 8) + [(500 + i, [0.25] * 8) for i in range(40)] + [(500, [0.5] * 8)]  # a hot vector, a repeated id
    rows += [(600, None), (601, []), (602, [1.0] * 7), (603, [1.0, None] + [0.0] * 6), (604, [float("nan")] * 8), (605, [float("inf")] * 8), (None, [1.0] * 8), (606, [1.0] * 9)]
    check(spark, rows, 16, 3, 8)
    check(spark, [(1, [1.0] * 4), (2, [1.0] * 4), (3, [2.0] * 4)], 16, 3, 4)  # fewer vectors than centroids; equal centroids: the smaller number
    found, centroids = cc.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.count() == 0 and len(centroids) == 0


def test_large_components_are_exact(spark):
    rows = [(i, [2.0**k + i, -(2.0**k), float(i)]) for i, k in enumerate((0, 20, 24, 30, 40, 3, 22, 31))]
    check(spark, rows, 3, 2, 3, "double")


def test_bounds_hold_and_screen():
    rng = np.random.default_rng(4)
    spots = rng.normal(size=(16, 64)) * 12
    x = np.floor(spots[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 64)) * 2).astype(np.int64)
    c = np.floor(spots).astype(np.int64)
    form, norm = cc.compressed(x)
    cform, cnorm = cc.compressed(c)
    exact = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (norm[:, None] + cnorm[None] - 2 * form @ cform.T <= exact + 1e-6 * exact.max()).all()
    near, best, taken = cc.nearest(x, form, norm, c)
    assert (near == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert taken < 4000 * 2  # of 16 centroids fewer than two get an exact distance
    flat = rng.integers(-20, 20, (500, 64))
    near, best, taken = cc.nearest(flat, *cc.compressed(flat), c)
    assert (best == ((flat[:, None] - c[None]) ** 2).sum(2).min(1)).all()


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(cc.SQL)
    names = [c[0] for c in want.description]
    rows = sorted(want.fetchall())
    assert len(rows) == 500 and sorted(tuple(r) for r in cc.op13_centroid_clusters(spark, sf).select(*names).collect()) == rows
