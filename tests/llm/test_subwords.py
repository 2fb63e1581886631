import pytest

from lodeworks.llm import subwords


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return subwords.Subwords(public_tokenizers.path("piece_bpe_32k.model"))


def parts(model, text, key, dropout):
    """The segmentation of each word of a text: pieces that start with U+2581 start a word."""
    out = []
    for i in model.encode([text], [key], dropout=dropout)[0].tolist():
        if model.text[i].startswith(subwords.SPACE):
            out.append(())
        out[-1] += (model.text[i],)
    return out


def test_each_occurrence_draws_for_itself(model):
    seen = parts(model, " ".join(["international"] * 3000), 1, 0.1)
    assert len(seen) == 3000 and len(set(seen)) > 8
    one = next(w for w in ("a", "o", "e", "i") if len(model.pairs) and model.encode([w], [0], dropout=0)[0].size == 1)
    dropped = [x != (subwords.SPACE + one,) for k in range(4) for x in parts(model, " ".join([one] * 5000), k, 0.1)]
    assert len(dropped) == 20_000 and 0.09 < sum(dropped) / len(dropped) < 0.11


def test_shared_work_equals_each_occurrence_alone(model):
    text = " ".join(["the", "international", "rest", "of", "é漢", "straßenbahn", "a"] * 60)
    for dropout in (0.1, 0.5):
        limit = int(dropout * (1 << 24))
        alone = []
        for place, w in enumerate(text.split()):
            alone += model.slow([subwords.SPACE, *w], subwords._mix(subwords.SEED, 7, place), limit)
        assert model.encode(["x " * 50, text], [6, 7], dropout=dropout)[1].tolist() == alone


def test_columns_empty_tables_and_repeats(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "the rest of it", "x"), (1, "the rest of it", "y"), (None, None, "z"), (4, "", None)], "doc_id long, text string, pieces string")
    rows = subwords.encode_documents(docs, path).withColumn("back", subwords.decoder(path)("pieces")).collect()
    assert [r["back"] for r in rows] == [r["text"] or "" for r in rows] and rows[0]["pieces"] == rows[1]["pieces"]
    assert subwords.encode_documents(docs.limit(0), path).count() == 0
    both = docs.select("text", subwords.round_trip(path)("text", "doc_id").alias("r")).select("text", "r.*").collect()
    assert [(r["pieces"], r["decoded"]) for r in both] == [(r["pieces"], r["back"]) for r in rows]
