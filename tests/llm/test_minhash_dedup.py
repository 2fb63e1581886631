import random
import re

import numpy as np

from lodeworks.llm import minhash_dedup as md


def brute(rows, words, num, den):
    """rows: doc_id, text -> sorted (doc_id, n_shingles, component_id, kept), by all pairs that share a shingle."""
    sets, by = {}, {}
    for k, (i, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        for x in sets[k]:
            by.setdefault(x, []).append(k)
    root = {i: i for i, _ in rows if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, s in sets.items():
        if rows[k][0] is None:
            continue
        for o in {o for x in s for o in by[x] if o < k and rows[o][0] is not None}:
            common = len(s & sets[o])
            if den * common >= num * (len(s) + len(sets[o]) - common):
                a, b = find(rows[k][0]), find(rows[o][0])
                root[max(a, b)] = min(a, b)
    comp = [None if i is None else find(i) for i, _ in rows]
    return sorted([(i, len(sets[k]), comp[k], comp[k] == i) for k, (i, _) in enumerate(rows)], key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Ärger", "ZWEI", "zwei"]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:  # edits of an earlier text, more and less alike than the threshold
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
        elif kind < 0.6:
            rows.append((i, rng.choice(["", " \t\n", None, "one two", "ONE Two", "a b c d e", "A B c d e"])))
        else:
            rows.append((i, rng.choice([" ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randint(1, 400)))))
    return rows


def got(df, *args):
    return sorted((tuple(r) for r in md.near_duplicates(df, *args).collect()), key=str)


def test_equals_brute_force(spark):
    for seed, num in ((1, 85), (2, 80)):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
        assert got(df, 5, num, 100) == brute(rows, 5, num, 100)


def test_many_near_copies_and_one_shared_passage(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    base = [f"b{i}" for i in range(300)]
    rows += [(1000 + i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 5, 85, 100) == brute(rows, 5, 85, 100)


def test_nulls_repeats_long_and_empty(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(7, "a b c d e f"), (7, "x y z u v w"), (3, "x y z u v w"), (9, "a b c d e f"), (None, "a b c d e f"), (8, None), (20, long), (21, long + " more")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, halves string")
    assert got(df, 5, 85, 100) == sorted([(7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True), (9, 2, 3, False), (None, 2, None, True), (8, 0, 8, True), (20, 59996, 20, True), (21, 59997, 20, False)], key=str)
    assert got(df.limit(0), 5, 85, 100) == []


def test_tables_are_pairs_of_half_keys():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 300)]
    sketcher = md.Sketcher(4, 2)
    assert len(sketcher.factors) == 16  # where 16 tables of their own would take 64
    halves = sketcher(sets)
    alone = np.concatenate([sketcher([s]) for s in sets])
    assert (halves == alone).all()
    keys = md.table_keys(halves)
    assert keys.shape == (3, 16) and len(np.unique(keys)) == 48
    other = halves.copy()
    other[:, 1] += np.uint64(1)  # one half key differs: its four tables do
    assert ((md.table_keys(other) != keys).reshape(3, 4, 4).all(2) == [False, True, False, False]).all()


def test_half_keys_agree_as_often_as_likeness_says():
    rng = np.random.default_rng(6)
    sketcher, agree, met, tries = md.Sketcher(), 0, 0, 300
    for _ in range(tries):
        x = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
        y = np.concatenate([x[32:], rng.integers(0, 2**64, 32, dtype=np.uint64)])  # likeness 368 / 432 = 0.852
        a, b = sketcher([x, np.sort(y)])
        same = a == b
        agree += same.sum()
        met += bool(same[: md.HALVES].any() and same[md.HALVES :].any())
        assert bool((md.table_keys(a[None]) == md.table_keys(b[None])).any()) == bool(same[: md.HALVES].any() and same[md.HALVES :].any())
    assert abs(agree / (tries * 2 * md.HALVES) - (368 / 432) ** md.WIDTH) < 0.03
    assert met == tries and md.miss_chance(0.85) < 3e-5


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in md.op11_minhash_dedup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert found == brute(rows, 5, 85, 100)
