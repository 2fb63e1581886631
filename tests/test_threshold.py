import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import memory, retrieval, threshold


def planted(seed, n, dim, spots):
    """Vectors around spots, and near copies of every tenth."""
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(spots, dim))
    rows = [(i, (at[rng.integers(spots)] + 0.4 * rng.normal(size=dim)).tolist()) for i in range(n)]
    near = [(n + i, (np.array(v) + 0.1 * rng.normal(size=dim)).tolist()) for i, v in rows[::10]]
    return rows + near


def slow(probes, entries, least, own):
    best = retrieval.top_k_batch(probes.select(F.col("probe_id").alias("query_id"), F.col("vec").alias("query_vec")), entries.select(F.col("entry_id").alias("vec_id"), F.col("vec").alias("embedding")), 1, own)
    return sorted((r["query_id"], r["vec_id"], r["score"]) for r in best.filter((F.col("score") >= least) & (F.col("score") > 0)).collect())


@pytest.mark.parametrize("least", [0.35, 0.95, 0.999, -1.0])
def test_equals_the_scan_of_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(threshold, "PART", 60)
    monkeypatch.setattr(threshold, "PROBES", 40)
    rows = planted(1, 900, 24, 30) + [(5000 + i, [0.5] * 24) for i in range(100)] + [(6000, [0.0] * 24), (6001, [1.0] * 3), (6002, [1.0, 1.0, 0.9]), (6003, [])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    entries = v.select(F.col("id").alias("entry_id"), "vec")
    probes = v.filter("id % 7 = 0 OR id > 5990").select(F.col("id").alias("probe_id"), "vec")
    for own in (True, False):
        got = sorted((r["probe_id"], r["entry_id"], r["score"]) for r in threshold.nearest_within(probes, entries, least, own).collect())
        assert got == slow(probes, entries, least, own)
        assert least > 0.99 or len(got) > 40


def test_a_tight_threshold_scores_few_pairs(spark):
    v = spark.createDataFrame(planted(2, 4000, 32, 40), "id long, vec array<double>")
    entries, probes = v.select(F.col("id").alias("entry_id"), "vec"), v.filter("id % 10 = 0").select(F.col("id").alias("probe_id"), "vec")
    every = entries.count() * probes.count()
    tight = threshold.nearest_within(probes, entries, 0.95, True, counts=True).first()
    loose = threshold.nearest_within(probes, entries, 0.35, True, counts=True).first()
    assert tight["scored"] < every / 50 and tight["pairs"] < every / 2 and tight["scored"] < loose["scored"] <= loose["pairs"] <= every
    assert threshold.nearest_within(probes, entries, 0.95, True).count() > 300


def test_lookup_takes_live_answers_alone(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0], "one"), (2, [1.0, 0.01], None), (3, [1.0, 0.005], ""), (4, [0.0, 1.0], "four")], "entry_id long, vec array<double>, answer string")
    probes = spark.createDataFrame([(9, [1.0, 0.01]), (8, [-1.0, 0.0]), (7, None), (6, [0.0, 0.0])], "probe_id long, vec array<double>")
    assert [tuple(r) for r in memory.cache_lookup(probes, entries).collect()] == [(9, 1, 0.99995, "one")]
    assert memory.cache_lookup(probes, entries.limit(0)).count() == 0 and memory.cache_lookup(probes.limit(0), entries).count() == 0


def test_pairs_are_looked_at_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(threshold, "CELLS", 500)
    v = spark.createDataFrame(planted(3, 600, 16, 5), "id long, vec array<double>")
    entries, probes = v.select(F.col("id").alias("entry_id"), "vec"), v.filter("id % 4 = 0").select(F.col("id").alias("probe_id"), "vec")
    got = sorted((r["probe_id"], r["entry_id"], r["score"]) for r in threshold.nearest_within(probes, entries, 0.35, True).collect())
    assert got == slow(probes, entries, 0.35, True) and len(got) > 100
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
