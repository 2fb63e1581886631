import pytest

from lodeworks.llm import language_id


@pytest.fixture(scope="module")
def model():
    texts = [("xx", "the and ing a sh"), ("yy", "der ung sch o ü")] * 60
    return language_id.fit([t for _, t in texts], [x for x, _ in texts])


@pytest.mark.parametrize("text", ["A.", "a a a a", "s p a c e d", "1 a 2", "ü", "ж"])
def test_a_text_with_a_letter_has_a_language(model, text):
    names, p = model.predict(["", text, "12"])
    assert names[1] in ("xx", "yy") and p[1] > 0 and names[0] == names[2] == "und"


def test_single_letters_tell_languages_apart(model):
    assert model.predict(["a a", "o o"])[0] == ["xx", "yy"]


def _write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{path}/documents.parquet")


def test_contract_of_the_query(spark, tmp_path):
    import random
    import zlib

    r = random.Random(3)
    make = {"xx": ["the", "and", "ing", "sh"], "yy": ["der", "ung", "sch", "zu"]}
    text = lambda p: " ".join("".join(r.choice(p) for _ in range(3)) for _ in range(25))
    rows = [(i, text(make["xx" if i % 2 else "yy"]), "xx" if i % 2 else "yy", "k") for i in range(240)]
    # Labels of the held-out fold are wrong throughout: none of them may be learned.
    held = {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = [(i, t, ("zz" if i in held else lang), k) for i, t, lang, k in rows]
    rows += [(900, None, "xx", "k"), (901, "12 - 3", None, "k"), (902, "", "yy", "k"), (None, "the and", None, "k"), (7, rows[7][1], "xx", "k")]
    _write(spark, tmp_path, rows)
    got = language_id.op4_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["held_out"] == (i in held) for i in range(240)) and by[None]["held_out"] is False
    assert sum(by[i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in held) >= 0.97 * len(held)
    assert {by[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and all(by[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= x["score"] <= 1 for x in got)


def test_empty_table_and_no_labels(spark, tmp_path):
    _write(spark, tmp_path, [])
    assert language_id.op4_language_id(spark, str(tmp_path)).count() == 0
    _write(spark, tmp_path / "b", [(3, "the and", None, None)])
    assert language_id.op4_language_id(spark, str(tmp_path / "b")).first()["lang_pred"] == "und"


def test_pieces_end_where_words_do():
    text = "ab cde " * 400 + "x" * 50 + " é1f"
    assert "".join(text[a:b] for a, b in language_id.pieces(text, 7)) == text
    import numpy as np

    count = lambda parts: sorted((int(h)) for p in parts for _, hs in language_id.grams(language_id.codes(p)) for h in np.asarray(hs))
    assert count([text]) == count([text[a:b] for a, b in language_id.pieces(text, 7)])
