import random
import re

import numpy as np
import pytest

from lodeworks.llm import jaccard_join as jj


def brute(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(rows[x][0]), find(rows[y][0])
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


def corpus(seed, n):
    r = random.Random(seed)
    base = [[f"w{r.randrange(60)}" for _ in range(r.choice([1, 2, 3, 8, 20, 40, 41, 90]))] for _ in range(n)]
    rows = []
    for i, w in enumerate(base):
        rows.append(" ".join(w))
        for _ in range(r.randrange(6)):
            v = list(w)
            for _ in range(r.randrange(0, 3)):
                k = r.randrange(max(1, len(v)))
                v[k : k + 1] = r.choice([[], ["zz"], [*v[k : k + 1], f"w{r.randrange(60)}"]])
            rows.append("  ".join(v).upper() if r.random() < 0.2 else " ".join(v))
    rows += ["", None, " \t", "é", "É", rows[0], rows[0]]
    r.shuffle(rows)
    return [(i * 3 % 10007, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words,num,den,tile,near,thin", [(3, 9, 10, 2_000_000, 8, 1_000_000), (5, 4, 5, 300, 2, 200), (2, 3, 5, 300, 3, 1_000_000)])
def test_equals_brute_force(spark, monkeypatch, words, num, den, tile, near, thin):
    monkeypatch.setattr(jj, "TILE", tile)
    monkeypatch.setattr(jj, "NEAR", near)
    monkeypatch.setattr(jj, "THIN", thin)
    rows = corpus(words, 60)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = sorted(tuple(r) for r in jj.jaccard_components(df, words, num, den).collect())
    assert got == brute(rows, words, num, den)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(7, "a b c d e"), (7, "x y z u v"), (3, "x y z u v"), (9, "a b c d e"), (None, "a b c d e"), (8, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jj.jaccard_components(df, 3, 9, 10).collect()), key=str)
    assert got == sorted([(7, 3, 3), (7, 3, 3), (3, 3, 3), (9, 3, 3), (None, 3, None), (8, 0, 8)], key=str)
    assert jj.jaccard_components(df.limit(0), 3, 9, 10).count() == 0
    assert jj.one_of_each(df, 3, 9, 10).count() == 3


def test_linked_sets_share_a_digest():
    rng = np.random.default_rng(1)
    bands = jj.Bands(9, 10, 5000)
    for n in (1, 2, 9, 10, 11, 19, 50, 300, 2000):
        for _ in range(20):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            k = int(n * 0.1)
            drop = rng.integers(0, k + 1)
            b = np.unique(a)[drop:]
            extra = rng.integers(0, 2**63, rng.integers(0, k + 1)).astype(np.uint64)
            b = np.unique(np.concatenate([b, extra]))
            a = np.unique(a)
            i, u = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 10 * i >= 9 * u:
                assert len(np.intersect1d(jj.part_digests(a, bands), jj.part_digests(b, bands))), (n, i, u)


def test_long_words_that_differ_are_told_apart():
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = bits.translate(str.maketrans("ab", "ba"))
    one, two, same = jj.Shingler(3)([f"x {bits} y", f"x {other} y", f"X {bits.upper()} Y"])
    assert one.tolist() != two.tolist() and one.tolist() == same.tolist()


def test_signatures_never_exclude_a_link():
    rng = np.random.default_rng(2)
    for n in (1, 5, 33, 400, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.0, 0.5, 0.95, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 2**63, max(1, n // 30)).astype(np.uint64)]))
            x, y = (np.frombuffer(jj.signature(v), np.uint64) for v in (a, b))
            i = len(np.intersect1d(a, b))
            linked = 10 * i >= 8 * (len(a) + len(b) - i)
            may = jj._may_link(len(a), len(b), x, y, 8, 10)
            assert may or not linked
            assert not may or share > 0.4 or n < 40


def test_pairs_of_a_range_keep_all_together():
    rng = np.random.default_rng(3)
    for _ in range(30):
        d, n = rng.integers(0, 40, 200).astype(np.uint32), rng.integers(-20, 20, 200)
        extra = rng.integers(-20, 20, (int(rng.integers(0, 4)), 2))
        kept, near = jj._pairs_of(d, n, extra)
        groups = [sorted(set(n[d == x].tolist())) for x in set(d.tolist())]
        root = {x: x for x in range(-20, 20)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in kept.tolist():
            root[find(b)] = find(a)
        assert len(kept) < 40
        pairs = set(map(tuple, near.tolist()))
        for g in groups:
            for i, a in enumerate(g):
                for b in g[i + 1 :]:
                    assert find(a) == find(b) or (len(g) <= jj.NEAR and (a, b) in pairs)


def test_join_class(spark):
    from pyspark.sql import functions as F

    from lodeworks.llm.common import join_class

    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1500)).alias("k"))
    classes = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    want = {(r["id"], r["k"], r["least"]) for r in rows.join(classes.drop("n"), "k", "left").collect()}
    got = join_class(rows, classes, "k", "n", 5000).select("id", "k", "least").collect()
    assert len(got) == 5000 and {tuple(r) for r in got} == want


def test_only_sets_that_signatures_link_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(jj, "NEAR", 2)
    r = random.Random(5)
    word = lambda: f"v{r.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(40))])) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(3)]
    handed, links = [], jj._links
    monkeypatch.setattr(jj, "_links", lambda docs, classes, groups, *more: handed.append(groups.count()) or links(docs, classes, groups, *more))
    # sixty words in common keep all together by some digest, but only three pairs can be links
    monkeypatch.setattr(jj, "part_digests", lambda x, bands, counts=None: np.append(np.unique(x)[:1] * np.uint64(0), x).astype(np.uint64))
    got = sorted(tuple(x) for x in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 9, 10).collect())
    assert got == brute(rows, 3, 9, 10) and handed == [6]


def test_slices_of_a_range_give_the_same_pairs(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = jj.ranged(rng.integers(0, 2**63, 300).repeat(3).astype(np.uint64), rng.integers(0, 50, 900), 1)
    found = []
    for most in (10**6, 100):
        monkeypatch.setattr(jj, "SLICE", most)
        batches = list(jj._pairer([pa.RecordBatch.from_pandas(rows, preserve_index=False)]))
        found.append({tuple(sorted(p)) for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())})
        assert len(batches) == (1 if most == 10**6 else 9)
    assert found[0] == found[1]


def test_strangers_with_a_passage_in_common_are_no_rows(spark, monkeypatch):
    made, paired = [], jj.paired
    monkeypatch.setattr(jj, "paired", lambda *a, **k: made.append(paired(*a, **k)) or made[-1])
    for each in (2, 8):
        r = random.Random(each)
        word = lambda: f"v{r.randrange(10**6)}"
        passages = [[word() for _ in range(60)] for _ in range(12)]
        rows = [" ".join([*passages[i % 12], *(word() for _ in range(40))]) for i in range(12 * each)]
        rows = list(enumerate([*rows, *(f"{t} end" for t in rows[::4])]))
        got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 4, 5)
        assert sorted(tuple(x) for x in got.collect()) == brute(rows, 5, 4, 5)
        # a quarter has a copy
        assert made[-1].select("a", "b").distinct().count() == 3 * each


def test_parities_and_sizes_never_part_a_link():
    rng = np.random.default_rng(6)
    for num, den in ((4, 5), (9, 10)):
        bands = jj.Bands(num, den, 1 << 40)
        for n in (1, 5, 33, 400, 3000):
            for share in (0.0, 0.5, 0.8, 0.9, 0.95, 1.0):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 2**63, max(1, n // 30)).astype(np.uint64)]))
                tile = int(min(bands.of(len(a)), bands.of(len(b))))
                maps = np.stack([np.frombuffer(jj.parities(v, bands.parities(tile)), np.uint64) for v in (a, b)])
                may = len(jj.Known(np.array([-7, 3]), np.array([len(a), len(b)]), maps).may_link(np.array([[-7, 3], [3, -7]]), num, den))
                i = len(np.intersect1d(a, b))
                assert may == 2 or den * i < num * (len(a) + len(b) - i)
                assert may == 0 or share > 0.5
    # two sets of one name: what parts one of them must not part the other
    known = jj.Known(np.array([1, 2, 1]), np.array([50, 50, 50]), np.array([[0], [0], [2**40 - 1]], np.uint64))
    assert known.may_link(np.array([[1, 2]]), 4, 5).tolist() == [[1, 2]]


def test_slices_of_a_range_say_nothing_twice(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    digests, nodes = rng.integers(0, 2**63, 200).astype(np.uint64).repeat(12), rng.integers(0, 400, 2400)
    rows = pa.RecordBatch.from_pandas(jj.ranged(digests, nodes, 1), preserve_index=False)
    labels = []
    for most in (10**6, 100):
        monkeypatch.setattr(jj, "SLICE", most)
        pairs = np.concatenate([np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in jj._pairer([rows])])
        kept = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in jj._pairer([rows])])
        assert kept.sum() < 400 and len(np.unique(pairs, axis=0)) == len(pairs)
        labels.append(dict(zip(*(x.tolist() for x in jj._forest(pairs)))))
    assert labels[0] == labels[1]
