import random

import corpus_pipeline as cp
from lodeworks.llm import language_id, mixing, subwords


def documents(spark, path, n=120):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["an", "the", "re", "on", "ed", "ing"]) for _ in range(r.randint(1, 4)))
    docs = []
    for i in range(n):
        t = " ".join(word() for _ in range(40))
        docs.append((i, t + (" idiot" if i % 6 == 0 else "") + (" mail a@b.co" if i % 5 == 0 else ""), "en" if i % 2 else "de", f"src{i % 3}", 1, "k"))
    docs += [(n + i, docs[i * 6 + 1][1], "en", "src0", 1, "k") for i in range(5)] + [(n + 9, None, None, None, None, "k"), (n + 10, "", "en", "src1", 0, "k")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {d[0]: d for d in docs}


def test_stages(spark, tmp_path):
    docs = documents(spark, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cols, left = df.columns, set(docs)
    for k, (name, stage) in enumerate(cp.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{k}.parquet")
        df = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert df.columns[: len(cols)] == cols
        rows = {r["doc_id"]: r for r in df.collect()}
        if name == "toxicity":
            assert {i for i in left if i % 6 or i >= 120} == set(rows)
        if name == "near_duplicates":
            assert set(rows) == left - {120, 121, 122, 123, 124}
        if name == "pii":
            assert set(rows) == left and all("@" not in (r["text"] or "") for r in rows.values())
            assert rows[5]["text"].endswith("[EMAIL]") and rows[5]["n_chars"] == len(rows[5]["text"])
        if name == "mixing":
            assert 0.5 * len(left) < len(rows) < len(left)
        left = set(rows)
    model = subwords.model_at(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    assert all(model.decode(r["pieces"]) == (r["text"] or "") for r in rows.values())
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} == left


def test_mixing_totals(spark):
    rows = [(i, "w " * (i % 7), f"l{i % 2}", f"s{i % 5}") for i in range(600)] + [(None, None, None, None), (3, "w " * 3, "l1", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(share=(7, 10), epochs=2)
    got = mixing.mix_documents(df, mix).collect()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert 0 <= sum(r["tokens"] for r in got) - total * 7 // 10 < 60
    assert mixing.mix_documents(df.limit(0), mix).count() == 0


def test_language_id(spark):
    r = random.Random(1)
    make = {"xx": ["the", "and", "ing", "sh"], "yy": ["der", "ung", "sch", "ü"], "zz": ["que", "ció", "ll", "ar"]}
    texts = [(lang, " ".join("".join(r.choice(p) for _ in range(3)) for _ in range(30))) for lang, p in make.items() for _ in range(60)]
    model = language_id.fit([t for _, t in texts[::2]], [x for x, _ in texts[::2]])
    names, p = model.predict([t for _, t in texts[1::2]] + [None, "", "12 - 3", "the and", "x" * 300_000 + " the" * 300_000])
    assert sum(a == b for a, (b, _) in zip(names, texts[1::2])) >= 88
    assert names[90:93] == ["und"] * 3 and names[93] == "xx" and all(0 <= x <= 1 for x in p)
    one, _ = model.predict(["the and " * 200_000])
    assert one == ["xx"]


def test_subwords_equal_the_library_without_dropout():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, sp = subwords.Subwords(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "  a", " a  b\n\tc d", "▁", "▁▁x ▁", "é漢字😀\x00　ﬁ ", "x" * 500, "ab " * 50 + "y" * 80, None, "the rest of it " * 40]
    for dropout in (0, 0.1, 0.6):
        out = m.encode(texts, list(range(len(texts))), dropout=dropout)
        for t, x in zip(texts, out):
            assert m.decode(x.tolist()) == (t or "")
            if dropout == 0 and t and "▁" not in t:
                assert x.tolist() == sp.encode(t)
    a, b = m.encode([texts[-1]] * 2, [1, 2], dropout=0.3)
    assert a.tolist() != b.tolist() and a.tolist() == m.encode([texts[-1]], [1], dropout=0.3)[0].tolist()
