"""Plain versions of operators that SQL can't express, written apart from their code."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import fingerprints as fp
from lodeworks.llm import jaccard_join, language_id, mixing, subwords
from tests.llm.test_minhash_dedup import brute

SF = "/root/testdata/sf0.001"


def merged(sp, word, key, limit):
    """Merges a word's symbols: the best pair by the library's score, then place; a pair whose draw says so is left alone."""
    symbols = [(i, c) for i, c in enumerate(word)]
    while True:
        found = []
        for k in range(len(symbols) - 1):
            piece = sp.piece_to_id(symbols[k][1] + symbols[k + 1][1])
            if piece != sp.unk_id():
                skipped = limit and int(subwords._mix(key, subwords._mix(symbols[k][0], piece))) >> 40 < limit
                if not skipped:
                    found.append((-sp.get_score(piece), symbols[k][0], k))
        if not found:
            return [s for _, s in symbols]
        k = min(found)[2]
        symbols[k : k + 2] = [(symbols[k][0], symbols[k][1] + symbols[k + 1][1])]


def test_dropout_equals_a_plain_merger():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), subwords.Subwords(path)
    rng = random.Random(1)
    words = ["international", "the", "unbelievable", "banana", "mississippi", "a", "aaaaaaaa", "consideration"] + ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 30))) for _ in range(60)]
    for dropout in (0.0, 0.1, 0.6):
        limit = int(dropout * (1 << 24))
        got = [model.text[i] for i in model.encode([" ".join(words)], [5], dropout=dropout)[0].tolist()]
        want = []
        for place, w in enumerate(words):
            want += merged(sp, subwords.SPACE + w, int(subwords._mix(subwords.SEED, 5, place)), limit)
        assert got == want, dropout


def test_sentencepiece_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in subwords.op1_sentencepiece(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        x = got[r["doc_id"]]
        assert x["lossless"] and x["n_chars"] == len(text) and x["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def predicted(model, text):
    """Features of each word: runs of two and three letters, and those with an end of the word; their mean logits."""
    sums = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        if not all(c.isalpha() for c in word):
            continue
        x, padded = [ord(c) for c in word], [0, *map(ord, word), 0]
        for n in language_id.SIZES:
            each = [x[i : i + n] for i in range(len(x) - n + 1)]
            each += [w for i in range(len(padded) - n) if (w := padded[i : i + n + 1]) and ((w[0] == 0) != (w[-1] == 0) or (n == 2 and w[0] == w[-1] == 0))]
            for gram in each:
                h = 0
                for c in gram:
                    h = ((h ^ c) * 0x9E3779B97F4A7C15) % 2**64
                    h ^= h >> 29
                sums.append(model.logits[(h >> 40) % language_id.BUCKETS].astype(float))
    if not sums:
        return "und", 0.0
    z = (np.mean(sums, 0) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.names[int(p.argmax())], float(p.max())


@pytest.fixture(scope="module")
def languages():
    rows = duckdb.connect().execute(f"SELECT text, lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    return language_id.fit([t for t, _ in rows], [x for _, x in rows]), rows


def test_language_equals_a_plain_prediction(languages):
    model, rows = languages
    texts = [t for t, _ in rows[:60]] + ["", "1 2 3!", "A.", "a a a", "Straße ÖL", "x" * 3000]
    names, scores = model.predict(texts)
    for t, name, score in zip(texts, names, scores):
        want, p = predicted(model, t)
        assert name == want and abs(score - p) < 1e-5, t[:50]


def test_calibration_and_rejection(languages):
    model, rows = languages
    names, scores = model.predict([t for t, _ in rows])
    right = np.array([n == x for n, (_, x) in zip(names, rows)])
    assert right.mean() > 0.95 and abs(scores.mean() - right.mean()) < 0.1  # scores are about as high as they are right
    foreign, p = model.predict(["зштщ жыэъ фцчш юяьъ " * 20, "漢字仮名交 文章体裁 " * 20])
    assert (p < model.least).all()  # letters of no language it knows are rejected
    assert np.mean([s >= model.least for s, ok in zip(scores, right) if ok]) > 0.9


def tree(text):
    """A fingerprint, by lists: leaves, sections that end at a leaf whose digest ends in 0, a root over sections."""
    leaves = [hashlib.md5(x.encode()).hexdigest() for x in re.findall(r"(?s).{0,254}?(?:[.!?]\x20|\n)|.{1,256}", text)]
    sections = [[]]
    for k, leaf in enumerate(leaves):
        sections[-1].append(leaf)
        if leaf.endswith("0") and k < len(leaves) - 1:
            sections.append([])
    spelt = [".".join(s) + ("." if k < len(sections) - 1 else "") for k, s in enumerate(sections)]
    root = hashlib.sha256("/".join(hashlib.sha256(s.encode()).hexdigest() for s in spelt).encode()).hexdigest()
    return root, [[x[:10] for x in s] for s in sections]


def alike(one, other):
    if one[0] == other[0]:
        return 1.0
    a, b = ({x for s in t[1] for x in s} or {""} for t in (one, other))
    return min(2 * len(a & b) / (len(a) + len(b)), 0.999999)


def test_fingerprints_equal_a_plain_tree(spark):
    rng = random.Random(2)
    lines = [f"Line {i} of a text. And so on! Is it? " for i in range(40)] + ["x" * 700, "\n", "é😀 漢字. ", "no end"]
    texts = ["", "a", "\n\n"] + ["".join(rng.choice(lines) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    pairs = [(i, rng.choice(texts), rng.choice(texts)) for i in range(150)] + [(1000 + i, t, t[: len(t) // 2] + "!" + t[len(t) // 2 :]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "i int, a string, b string").select("i", fp.fingerprint(F.col("a")).alias("x"), fp.fingerprint(F.col("b")).alias("y"))
    rows = {r["i"]: r for r in df.select("*", fp.likeness(F.col("x"), F.col("y")).alias("n"), fp.locate(F.col("x"), F.col("y")).alias("at")).collect()}
    several = 0
    for i, a, b in pairs:
        one, two, r = tree(a), tree(b), rows[i]
        several += len(one[1]) > 2
        for (root, sections), got in ((one, r["x"]), (two, r["y"])):
            assert got == f"{root}|" + "/".join(".".join(s) for s in sections)
        assert abs(r["n"] - alike(one, two)) < 1e-12
        lone = lambda p, q: [k + 1 for k, s in enumerate(p[1]) if s not in q[1]]
        assert (r["at"]["left_only"], r["at"]["right_only"]) == (lone(one, two), lone(two, one))
    assert several > 30


def test_mixing_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(mixing.sql())
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in mixing.op5_mixing(spark, SF).select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_ngram_join_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in jaccard_join.op9_ngram_join(spark, SF).collect()), key=str)
    assert got == sorted((r[:3] for r in brute(rows, 3, 90, 100)), key=str)
