import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lexical import brute, corpus

from lodeworks.operators import lexical, retrieval, terms
from lodeworks.plans.catalogue import QUERIES

ASKED = [(1, "w0 w3 w250"), (2, "w1, W2!"), (3, "w0 w20 nowhere"), (4, "nowhere"), (5, None), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")]



@pytest.mark.parametrize("cells", [7, 1_000_000])
def test_overlap_equals_the_join_and_shuffles_only_the_best(spark, monkeypatch, cells):
    monkeypatch.setattr(terms, "CELLS", cells)
    monkeypatch.setattr(terms, "ADDED", cells)
    docs = spark.createDataFrame(corpus(800), "doc_id long, text string").repartition(3).cache()
    q = retrieval.tokens(spark.createDataFrame(ASKED, "query_id int, text string"), "query_id", "text")
    want = retrieval.term_overlap(q, retrieval.tokens(docs, "doc_id", "text"), 10)
    found = retrieval.overlap_top_k(q, docs, 10)
    assert found.schema["query_id"].dataType == want.schema["query_id"].dataType
    rows = lambda df: sorted(tuple(r) for r in df.filter("doc_id IS NOT NULL").select("query_id", "doc_id", "score").collect())
    assert rows(found) == rows(want)
    assert retrieval.overlap_top_k(q.limit(0), docs, 10).count() == 0 and retrieval.overlap_top_k(q, docs.limit(0), 10).count() == 0
    # one row a document: no more than k rows of a query leave a task
    named = docs.filter("doc_id IS NOT NULL").withColumn("words", F.array_distinct(F.split("text", " ")))
    plan = terms.overlap(named, terms.local_queries(q), 10)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_overlap_of_repeated_ids_and_of_too_many_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "a"), (None, "a b c")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a"), (7, "b"), (7, "c")], "query_id long, token string")
    want = {(7, 1, 3), (7, 2, 1), (7, None, 3)}
    for most in (100, 2):
        monkeypatch.setattr(terms, "LOCAL", most)
        assert {tuple(r) for r in retrieval.overlap_top_k(q, docs, 5).select("query_id", "doc_id", "score").collect()} == want


def test_best_keeps_smaller_ids_of_equal_scores():
    best = terms.Best(1, 2)
    for ids, s in (([9, 5], [1.0, 1.0]), ([3, 8], [1.0, 0.0]), ([4], [2.0]), ([7], [1.0])):
        best.add(np.array(ids), np.array(s)[:, None])
    assert best.ids.tolist() == [4, 3] and best.s.tolist() == [2.0, 1.0]


def test_bm25_in_a_batch_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(terms, "ADDED", 50)
    monkeypatch.setattr(lexical, "build", lambda *_: pytest.fail("an index was built"))
    docs = corpus(600)
    q = spark.createDataFrame(ASKED, "query_id long, text string")
    found = lexical.bm25_batch(q, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 10)
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()) == brute(ASKED, docs, 10)


def test_bm25_of_repeated_ids_goes_through_the_index(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "a")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    want = lexical.bm25_top_k(q, lexical.build(docs, lexical.query_tokens(q)), 5).collect()
    assert lexical.bm25_batch(q, docs, 5).collect() == want


SF = "/root/testdata/sf0.001"


def test_registered_bm25_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(lexical, "build", lambda *_: pytest.fail("an index was built"))
    assert QUERIES["bm25_topk"](spark, SF).count() > 0


def test_rank_fusion_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(lexical, "build", lambda *_: pytest.fail("an index was built"))
    assert QUERIES["rank_fusion"](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["sparse_topk", "rerank_topn", "context_assembly", "answer_simple", "agent_answers", "ask_turns", "ask_cache_puts"])
def test_pairs_are_not_grouped(spark, monkeypatch, name):
    monkeypatch.setattr(retrieval, "term_overlap", lambda *_: pytest.fail("all pairs are grouped"))
    assert QUERIES[name](spark, SF).count() > 0
