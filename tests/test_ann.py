import numpy as np
from pyspark.sql import functions as F

from lodeworks.operators import ann, retrieval
from lodeworks.plans.catalogue import QUERIES


def clustered(seed, n, dim, spots):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(spots, dim))
    # a third of all vectors are equal
    return [(i, (at[0] if i % 3 == 0 else at[rng.integers(spots)] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def queries(v):
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def test_recall_of_the_query_is_at_least_nine_tenths(spark):
    for sf in ("sf0.01", "sf0.1"):
        folder = f"/root/testdata/{sf}"
        found = QUERIES["dense_topk_ann"](spark, folder)
        truth = QUERIES["dense_topk_batch"](spark, folder)
        assert ann.recall(found, truth) >= 0.9
        assert found.groupBy("query_id").count().filter("count <> 20").isEmpty()


def test_probes_and_codes_skip_most_rows_and_find_most_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 200)
    v = spark.createDataFrame(clustered(1, 6000, 32, 40), "vec_id long, embedding array<float>").repartition(5)
    index = ann.build(v, lists=50)
    assert index.quantiser.probes < 25  # half of the lists at most
    rows = index.blocks.select("list", "part", (F.length("ids") / 8).cast("int").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 6000  # every row is in the index
    assert max(r["n"] for r in rows) < 400 < max(sum(r["n"] for r in rows if r["list"] == x) for x in {r["list"] for r in rows})  # a hot list is split
    truth = retrieval.top_k_batch(queries(v), v, 20)
    found = ann.search(index, queries(v), 20)
    assert ann.recall(found, truth) >= 0.9
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in found.collect()}
    want = {(r["query_id"], r["vec_id"]): r["score"] for r in truth.collect()}
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got.keys() & want.keys())  # scores are exact ones
    assert ann.recall(ann.search(index, queries(v), 20, probes=1), truth) < ann.recall(found, truth)


def test_the_exact_way(spark):
    v = spark.createDataFrame(clustered(2, 900, 10, 7), "vec_id long, embedding array<float>")
    index = ann.build(v)
    exact = ann.search(index, queries(v), 15, probes=10**6, refine=None)
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"], r["score"])
    assert sorted(map(key, exact.collect())) == sorted(map(key, retrieval.top_k_batch(queries(v), v, 15).collect()))


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (None, [1.0, 0.0]), (3, []), (4, [1.0]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (100, [0.0, 1.0]), (7, [1.0, None]), (0, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(v)
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(index, queries(v).distinct(), 20, probes=99, refine=None).collect())
    assert {x[2] for x in found} <= {0, 1, 4, 5, 100} and (100, 1, 100) in found
    assert ann.build(v.limit(0)) is None
    assert QUERIES["dense_topk_ann"].__doc__
