import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from lodeworks.operators import lexical
from lodeworks.plans.catalogue import ORACLE_SQL, QUERIES


def brute(queries, docs, k):
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    held = [(i, Counter(words(t))) for i, t in docs if i is not None]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for q, t in queries:
        asked = set(words(t))
        s = {i: round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size * n / total)) for w in asked if c[w]), 6) for i, c, size in held if asked & c.keys()}
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted((-v, i) for i, v in s.items())[:k])]
    return sorted(out)


def corpus(n):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    word = lambda: vocab[min(int(rng.paretovariate(0.6)) - 1, 499)]
    return [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)] + [(None, "w0"), (9999, None), (9998, "")]


def test_equals_brute_force_and_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "PART", 300)  # several parts of common tokens
    docs = corpus(1500)
    asked = [(1, "w0 w3 w250"), (2, "w1, W2!"), (3, "w0 w20 nowhere"), (4, "nowhere"), (5, None), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), lexical.query_tokens(q))
    found = lexical.bm25_top_k(q, index, 10)
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()) == brute(asked, docs, 10)
    rows = lexical.weighed(lexical.query_tokens(q), index, 10)
    every = lexical.query_tokens(q).join(index.blocks, "token").groupBy("query_id").count()
    need = {r["query_id"]: r["count"] for r in lexical.needed_blocks(rows, index).groupBy("query_id").count().collect()}
    total = {r["query_id"]: r["count"] for r in every.collect()}
    # common tokens beside rare ones: most of their blocks are never looked into
    assert need[1] < total[1] / 2 and need[2] < total[2] / 2 and sum(need.values()) < 0.6 * sum(total.values())
    assert index.blocks.filter("n > 8").isEmpty() and index.blocks.filter("part > 0").count() > 0


def test_an_index_of_all_tokens_and_a_salted_join(spark, monkeypatch):
    docs, asked = corpus(300), [(1, "w0 w7"), (2, "w5")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(asked, docs, 5)
    whole = lexical.build(d)
    assert whole.tokens.count() > 100
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in lexical.bm25_top_k(q, whole, 5).collect()) == want
    monkeypatch.setattr(lexical, "few", lambda df: False)
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in lexical.bm25_top_k(q, lexical.build(d, lexical.query_tokens(q)), 5).collect()) == want
    assert lexical.bm25_top_k(q, lexical.build(d.limit(0)), 5).count() == 0


def test_queries_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("bm25_topk", "rank_fusion"):
        want = con.execute(ORACLE_SQL[name])
        cols = [c[0] for c in want.description]
        got = QUERIES[name](spark, sf).select(*[F.col(c) for c in cols]).collect()
        assert sorted(tuple(r) for r in got) == sorted(want.fetchall()), name
