import numpy as np
from pyspark.sql import functions as F

from lodeworks.llm import vector_search as vs


def brute(rows, k):
    v = {}
    ok = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            found = sorted((-sum(p * r for p, r in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vs, "BLOCK", 64)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 700)]  # a hot vector, ties
    rows += [(700, None), (701, []), (760, []), (702, [1.0, None] + [0.0] * 6), (703, [float("nan")] * 8), (704, [float("inf")] * 8), (720, [1e9] * 8), (740, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in vs.exact_topk(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [0.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vs.exact_topk(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 1, 8192), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert vs.exact_topk(df.limit(0), F.lit(True), 3).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [1.0, 2.0**44]), (1, [1.0, 0.5]), (2, [3.0, 2.0**-6]), (3, [2.0**45, 0.0]), (20, [2.0**-6, -(2.0**45)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vs.exact_topk(df, F.col("vec_id") % 20 == 0, 3).collect()) == [r for r in brute([(i, x) for i, x in rows], 20) if r[1] <= 3]


def test_repeated_query_ids_equal_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(1, 60)]
    rows += [(20, rng.normal(size=4).astype(np.float32).tolist()), (20, [1.0, 0.0, 0.0, 0.0]), (40, [0.5] * 4), (40, [0.5] * 4)]  # other vectors, equal vectors
    rows += [(60, [0.25, 0.0, 0.5, 0.0])] * 30  # more copies than k
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    want = sorted(duckdb.connect().execute(vs.SQL.replace("FROM embeddings", f"FROM read_parquet('{path}/*.parquet')")).fetchall())
    assert sorted(tuple(r) for r in vs.op3_topk(spark, str(tmp_path)).collect()) == want
    assert len(want) == 60


def test_annuli_are_skipped_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vs, "BLOCK", 50)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(8)
    at = rng.normal(size=(20, 8)) * 4
    rows = [(i, (at[i % 20] + 0.05 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    worked, asked, blocks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), []
    searcher, pairer = vs._searcher, vs._pairer

    def paired(dim, k, most, pivots, annuli, first, until):
        inner = pairer(dim, k, most, pivots, annuli, first, until)
        blocks.append(int(annuli[:, 4].sum()))

        def pair(batches):
            for pdf in batches:
                asked.add(len(pdf) if first == 0 else 0)
                yield from inner([pdf])

        return pair

    def counted(dim, k):
        inner = searcher(dim, k)

        def search(batches):
            for out in inner(batches):
                worked.add(len(out))
                yield out

        return search

    monkeypatch.setattr(vs, "_searcher", counted)
    monkeypatch.setattr(vs, "_pairer", paired)
    got = sorted(tuple(r) for r in vs.exact_topk(df, F.col("vec_id") % 20 == 3, 5).collect())
    ints = np.floor(64 * np.array([x for _, x in rows], np.float64)).astype(np.int64)
    want = []
    for q in range(3, 2000, 20):
        s = ints @ ints[q]
        best = sorted((-int(v), i) for i, v in enumerate(s) if i != q)[:5]
        want += [(q, n + 1, i, -v) for n, (v, i) in enumerate(best)]
    assert got == sorted(want)
    assert 0 < worked.value < asked.value * blocks[0] / 2  # of all pairs of query blocks and blocks fewer than half are looked at


def test_all_vectors_empty(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vs.exact_topk(df, F.col("vec_id") % 20 == 0, 3).collect()) == [(0, 1, 1, 0)]
