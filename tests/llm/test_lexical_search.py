import math
import random
import re
from collections import Counter

import numpy as np

from lodeworks.llm import lexical_search as ls


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k=20):
    held = [(i, Counter(split(t)), len(split(t))) for i, t in docs if i is not None]
    held = [d for d in held if d[2]]
    total, length = len(held), sum(d[2] for d in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(split(t))
    out = []
    for i, q in asked.items():
        scores = []
        for d, c, n in held:
            m = 75 + (25 * n * total) // length
            s = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(400)] + ["Öl", "öl", "日本", "A1", "a1"]
    word = lambda: vocab[min(int(rng.paretovariate(0.7)) - 1, len(vocab) - 1)]
    return [(i, rng.choice([" ", "-", "\x00", ", "]).join(word() for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(n)]


def found(spark, items, docs, k=20):
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, term string")
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int")
    return sorted(tuple(r) for r in ls.ranked_search(q, d, k).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ls, "GROUP", 2)
    monkeypatch.setattr(ls, "SHARD_DOCS", 70)
    monkeypatch.setattr(ls, "ITEM_TERMS", 60)  # several blocks of items
    docs = corpus(1, 600) + [(9000 + i, "t0 t1 t2 t2") for i in range(50)]  # ties
    items = [(100 + i, t[:80]) for i, t in corpus(2, 12)] + [(1, "t2 t2 t2 t1 nowhere"), (2, "nowhere"), (3, None), (4, "")]
    assert found(spark, items, docs) == brute(items, docs)
    assert found(spark, items, docs, 3) == brute(items, docs, 3)


def test_nulls_repeats_long_and_empty(spark):
    long = " ".join(f"v{i % 5000}" for i in range(80_000))
    docs = [(5, "a b c"), (5, "a b c"), (4, "a b c"), (None, "a a a"), (6, None), (7, ""), (8, " -- "), (9, long), (10, "zz")]
    items = [(1, "a"), (1, "b v1"), (None, "a"), (2, "zz v4999 a")]
    assert found(spark, items, docs) == brute(items, docs)
    assert found(spark, items, []) == [] and found(spark, [], docs) == []
    assert found(spark, items, [(1, None), (2, "...")]) == []


def test_postings_of_all_terms_or_of_those_asked_for(spark, monkeypatch):
    docs, items = corpus(3, 100), [(1, "t0 t5 t9")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = ls.cut(ls.item_terms(spark.createDataFrame(items, "item_id long, text string")))
    whole, some = ls.build_postings(d), ls.build_postings(d, wanted)
    assert whole.filter("kind = 2").count() > 20 and {bytes(r["term"]) for r in some.filter("kind = 2").collect()} <= {b"t0", b"t5", b"t9"}
    rows = [sorted(tuple(r) for r in ls.search(wanted, p).collect()) for p in (whole, some)]
    assert rows[0] == rows[1] == brute(items, docs)
    monkeypatch.setattr(ls, "ASKED_TERMS", 2)  # more are asked for: the lists of all terms
    assert ls.build_postings(d, wanted).filter("kind = 2").count() == whole.filter("kind = 2").count()


def test_block_ends_have_least_error():
    rng = random.Random(4)

    def least(x, cost, longest):
        best = [0]
        for i in range(1, len(x) + 1):
            best.append(min(best[j] + cost + (i - j) * max(x[j:i]) for j in range(max(0, i - longest), i)))
        return best[-1]

    lists = [np.array([rng.choice([1, 5, 9, 100, 101]) for _ in range(rng.randint(1, 40))], np.int64) for _ in range(60)]
    for cost, longest in ((7, 6), (150, 64), (0, 3)):
        for x, ends in zip(lists, ls.choose_blocks(lists, cost, longest)):
            starts = [0, *ends[:-1]]
            assert ends[-1] == len(x) and all(0 < e - s <= longest for s, e in zip(starts, ends))
            assert sum(cost + (e - s) * x[s:e].max() for s, e in zip(starts, ends)) == least(x.tolist(), cost, longest)
    even = ls.choose_blocks([np.array([9] * 10 + [1] * 20 + [9] * 10, np.int64)], 20, 64)[0]
    assert even.tolist() == [10, 30, 40]  # boundaries follow the impacts, not a fixed length


def test_search_skips_blocks_and_stays_exact(monkeypatch):
    monkeypatch.setattr(ls, "GROUP", 1)
    rng = np.random.default_rng(5)
    n, lists = 20_000, []
    for share in (0.5, 0.3, 0.1, 0.02, 0.001):
        docs = np.nonzero(rng.random(n) < share)[0]
        lists.append((docs, ls.impacts(rng.geometric(0.7, len(docs)), np.sort(rng.integers(20, 900, n))[docs], n, n * 400)))
    held = [ls.Postings(*x, e) for x, e in zip(lists, ls.choose_blocks([x[1] for x in lists]))]
    weights = [600, 1200, 2300, 3900, 6900]
    none = np.zeros(0, np.int64)
    scores, ids, many = ls.search_shard(list(zip(held, weights)), np.arange(n), 20, none, none)
    total = np.zeros(n, np.int64)
    for (docs, impact), w in zip(lists, weights):
        total[docs] += impact * w
    order = np.lexsort((np.arange(n), -total))[:20]
    assert ids.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    blocks = sum(len(p.most) for p in held)
    assert many < blocks // 5  # most blocks are never read
    again = ls.search_shard(list(zip(held, weights)), np.arange(n), 20, scores, ids - n)
    assert list(zip(again[0].tolist(), again[1].tolist())) == sorted([*zip(scores.tolist(), (ids - n).tolist()), *zip(scores.tolist(), ids.tolist())], key=lambda x: (-x[0], x[1]))[:20]
    assert again[2] < many  # a k-th score carried over from another shard leaves fewer


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in ls.op12_lexical_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()) == sorted(con.execute(ls.SQL).fetchall())
