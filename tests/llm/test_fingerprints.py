import hashlib

from pyspark.sql import functions as F

from lodeworks.llm import fingerprints as fp


def test_next_and_edits_match_brute_force(spark, tmp_path):
    rows = [(i * 7, f"Doc {i}. " + "A line of words here. " * (i % 9) + "\nLast é😀 " + str(i)) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 3000), (1002, "x" * 3000), (None, "lost")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, next_text int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = fp.op10_fingerprints(spark, str(tmp_path)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_tree(spark):
    a = "One two. Three four! Five\nSix seven. " * 30
    b = a[:400] + "changed " + a[400:]
    df = spark.createDataFrame([(a, b), (a, a), ("", ""), ("", None), ("a", "b")], "a string, b string")
    rows = df.select(fp.fingerprint(F.col("a")).alias("x"), fp.fingerprint(F.col("b")).alias("y")).select("x", "y", fp.likeness(F.col("x"), F.col("y")).alias("n"), fp.locate(F.col("x"), F.col("y")).alias("at")).collect()
    assert rows[0]["x"] != rows[0]["y"] and 0.5 < rows[0]["n"] < 1 and rows[0]["at"]["left_only"]
    assert rows[1]["x"] == rows[1]["y"] and rows[1]["n"] == 1 and rows[1]["at"]["left_only"] == []
    assert rows[2]["n"] == 1 and rows[3]["n"] == 1 and rows[4]["n"] == 0


def test_empty_table(spark):
    assert fp.with_next(spark.createDataFrame([], "doc_id long, text string"), ["text"]).count() == 0


def test_no_column_name_clashes(spark):
    names = ["_range", "_extra", "in0", "in1", "next0", "next_text"]
    df = spark.createDataFrame([(1, "a", *range(6)), (2, "b", *range(10, 16))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = {r["doc_id"]: r for r in fp.with_next(df, ["text"]).collect()}
    assert got[2]["next_text"] == "a" and got[1]["next_text"] == "b"
    assert [got[1][n] for n in names[:5]] == [0, 1, 2, 3, 4] and [got[2][n] for n in names[:5]] == [10, 11, 12, 13, 14]
