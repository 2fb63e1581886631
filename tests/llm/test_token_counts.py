import public_tokenizers as P
from tokenizers import Tokenizer

from lodeworks.llm import token_counts as tc

TEXTS = ["", None, "Hello world", "Hello world", "a<|endoftext|>b", "é ñ ß 漢字 😀", " \n\t  x" * 300, "don't we'll", "\u00a0x\u2003y", "x" * 5000, "word " * 30000, "a\x85b\x1cc"]


def test_counts_equal_the_library_and_cache_grows_by_misses(spark, tmp_path):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)], "doc_id int, text string, n_tokens string")
    args = (str(tmp_path / "cache"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    for rows in (df.limit(4), df, df):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tc.count_tokens(rows, *args).collect()}
        assert got == {i: (len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS) if i in got}
    stored = spark.read.parquet(f"{tmp_path}/cache/{tc.version_of(args[1])}")
    assert stored.count() == len(set(t or "" for t in TEXTS))
    assert tc.count_tokens(df.limit(0), *args).count() == 0


def test_sentencepiece_model(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    assert tc.count_tokens(df, str(tmp_path), P.path("piece_bpe_32k.model")).first()["n_tokens"] == 2


def test_query_wrapper_with_a_hot_text(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodeworks.llm import token_counts

    texts = ["the same text"] * 700 + [f"text {i} é漢" for i in range(300)] + [None, "", "<|endoftext|> x", "long word " * 2000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in token_counts.op8_token_counts(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)


def test_cache_is_used_and_empty_tables(spark, tmp_path):
    import public_tokenizers
    from pyspark.sql import functions as F

    from lodeworks.llm import token_counts

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    assert [r["n_tokens"] for r in token_counts.count_tokens(docs, cache, path).orderBy("doc_id").collect()] == [2, 2, 1]
    at = f"{cache}/{token_counts.version_of(path)}"
    assert spark.read.parquet(at).count() == 2
    token_counts.count_tokens(docs.union(spark.createDataFrame([(4, "d")], docs.schema)), cache, path).collect()
    assert spark.read.parquet(at).count() == 3
    # A stored count is believed, not encoded again.
    spark.createDataFrame([("zz",)], "t string").select(F.unhex(F.sha2("t", 256)).alias("content"), F.lit(77).cast("long").alias("n_tokens")).write.mode("append").parquet(at)
    assert token_counts.count_tokens(spark.createDataFrame([(5, "zz")], docs.schema), cache, path).first()["n_tokens"] == 77
    assert token_counts.count_tokens(docs.limit(0), cache, path).count() == 0


def test_no_column_name_clashes(spark, tmp_path):
    import public_tokenizers

    from lodeworks.llm import token_counts as tc

    names = ["_tokens", "__lw_key", "__lw_bytes", "__lw_hot", "content", "body", "in0", "_text", "n_bytes"]
    df = spark.createDataFrame([("a b", *range(9)), ("c", *range(10, 19))], "text string, " + ", ".join(f"{n} int" for n in names))
    got = {r["text"]: r for r in tc.count_tokens(df, str(tmp_path / "c"), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert [got["a b"][n] for n in names[:8]] == list(range(8)) and got["a b"]["n_bytes"] == 3 and got["c"]["n_tokens"] == 1


def test_both_encoders_agree_on_each_side_of_the_length_they_part_at(spark, tmp_path, monkeypatch):
    import public_tokenizers

    from lodeworks.llm import token_counts as tc

    texts = [("ab cd. " * 20)[:n] for n in (63, 64, 65, 66)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    own, fast = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(tc, "_LONG", 64)
    tc._made.clear()
    counts = [{r["id"]: r["n_tokens"] for r in tc.count_tokens(df, str(tmp_path / f"c{k}"), own, f).collect()} for k, f in enumerate((None, fast))]
    tc._made.clear()
    assert counts[0] == counts[1]
