import pytest
from pyspark.sql import functions as F

from lodeworks.operators import store
from lodeworks.streaming import sessions


def rows(spark, ids, v, text="x"):
    return spark.createDataFrame([(i, v, f"{text}{i}", {"k": str(v)}) for i in ids], "id long, v int, text string, m map<string,string>")


def held(s, number=None):
    return {r["id"]: (r["v"], r["text"]) for r in s.read(number).collect()}


def files(s):
    return {p for x in s._manifest()[1]["buckets"].values() for p in x["data"]}


def test_an_upsert_of_few_keys_leaves_most_files_alone(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"), 1024)
    s.upsert(spark.range(20_000).select("id", F.lit(1).alias("v"), F.lit("a").alias("text")), ["id"], "v")
    before = files(s)
    assert len(before) > 1000
    s.upsert(spark.createDataFrame([(i * 1999, 2, "b") for i in range(10)], "id long, v int, text string"), ["id"], "v")
    after = files(s)
    assert len(after) == len(before) and len(after - before) <= 10
    found = s.get(spark.createDataFrame([(1999,), (5,), (99_999,)], "id long"))
    assert sorted((r["id"], r["v"]) for r in found.collect()) == [(5, 1), (1999, 2)] and len(found.inputFiles()) <= 3
    assert s.read(1).filter("v = 2").isEmpty() and s.read(1).count() == 20_000  # readers of the old manifest see their version


def test_a_bucket_beyond_its_limit_splits(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"), 2, limit=100)
    s.upsert(rows(spark, range(50), 1), ["id"], "v")
    assert sorted(s._manifest()[1]["labels"]) == ["0", "1"]
    s.upsert(rows(spark, range(50, 1000), 1), ["id"], "v")
    manifest = s._manifest()[1]
    assert len(manifest["labels"]) > 8 and max(x["rows"] for x in manifest["buckets"].values()) < 150
    assert sum(x["rows"] for x in manifest["buckets"].values()) == 1000 and len(held(s)) == 1000
    assert sum(2.0 ** -len(x) for x in manifest["labels"]) == 1  # the directory covers every hash once
    s.upsert(rows(spark, [7, 2000], 2), ["id"], "v")
    assert held(s)[7] == (2, "x7") and len(held(s)) == 1001 and len(held(s, 1)) == 50
    whole = store.ChunkStore(spark, str(tmp_path / "one"), 1, limit=10)
    whole.upsert(rows(spark, range(5), 1), ["id"], "v")
    assert whole._manifest()[1]["labels"] == [""] and len(held(whole)) == 5


def test_deletes_write_keys_and_the_next_upsert_drops_them(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"), 4)
    s.upsert(rows(spark, range(100), 1), ["id"], "v")
    before = files(s)
    s.delete(F.col("id") < 30)
    assert files(s) == before and sorted(held(s)) == list(range(30, 100))
    assert sum(x["rows"] for x in s._manifest()[1]["buckets"].values()) == 70
    s.upsert(rows(spark, [3], 0), ["id"], "v")  # a key that went may come back, with any version
    assert held(s)[3] == (0, "x3") and len(held(s)) == 71
    s.delete(F.lit(True))
    assert held(s) == {} and s._manifest()[1]["buckets"] == {}
    s.delete(F.col("id") == 1)
    s.vacuum(1)
    assert held(s) == {} and not list((tmp_path / "c/data").glob("*/*"))


def test_changes_between_versions(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"), 8, limit=20)
    s.upsert(rows(spark, range(100), 1), ["id"], "v")
    s.upsert(rows(spark, [5, 300], 2), ["id"], "v")
    s.upsert(rows(spark, [6], 0), ["id"], "v")  # an older row: its bucket is written again, nothing changes
    s.delete(F.col("id") == 9)
    feed = s.changes(1, 4)
    got = {r["id"]: (r["change"], r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in feed.collect()}
    assert got == {5: ("changed", 1, 2), 300: ("added", None, 2), 9: ("removed", 1, None)}
    assert 0 < len(feed.inputFiles()) < len(files(s)) * 2 - 4  # shared folders aren't read
    assert s.changes(4, 4).isEmpty()
    back = {r["id"]: r["change"] for r in s.changes(4, 1).collect()}
    assert back == {5: "changed", 300: "removed", 9: "added"}
    s.upsert(spark.createDataFrame([(400, 1, "new")], "id long, v int, extra string"), ["id"], "v")
    assert {r["id"]: r["after"]["extra"] for r in s.changes(4, 5).collect()} == {400: "new"}


def test_two_writers_of_different_buckets_both_win(spark, tmp_path, monkeypatch):
    s = store.ChunkStore(spark, str(tmp_path / "c"), 64)
    s.upsert(rows(spark, range(200), 1), ["id"], "v")
    other, publish = store.ChunkStore(spark, str(tmp_path / "c"), 64), s._publish
    written = []

    def late(ids):
        """Before s publishes for the first time, the other writer does."""

        def go(number, manifest):
            if not written:
                written.append(files(other))
                other.upsert(rows(spark, ids, 5, "other"), ["id"], "v")
            publish(number, manifest)

        return go

    folders = []
    real = s._written
    monkeypatch.setattr(s, "_written", lambda *a: folders.append(a[0]) or real(*a))
    label = lambda i: next(iter(s._counts(rows(spark, [i], 1), ["id"], s._labels(s._manifest()[1]))))
    far = next(i for i in range(2, 100) if label(i) != label(1))
    monkeypatch.setattr(s, "_publish", late([far]))
    s.upsert(rows(spark, [1], 7, "mine"), ["id"], "v")
    assert held(s)[1] == (7, "mine1") and held(s)[far] == (5, f"other{far}") and len(folders) == 1  # nothing was written again
    written.clear()
    folders.clear()
    monkeypatch.setattr(s, "_publish", late([1]))
    s.upsert(rows(spark, [1], 6, "mine"), ["id"], "v")  # the same bucket: starts again from what the other left
    assert held(s)[1] == (7, "mine1") and len(folders) == 2
    with pytest.raises(store.Conflict):
        publish(s._numbers()[-1], s._manifest()[1])


def test_a_batch_delivered_again_or_late_changes_nothing(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"), 4)
    assert s.upsert(rows(spark, [1, 2], 1, "zero"), ["id"], "v", ("q", 0))
    assert s.upsert(rows(spark, [1], 1, "one"), ["id"], "v", ("q", 1))  # the same version: the newer batch's row
    version = s._numbers()[-1]
    assert not s.upsert(rows(spark, [1, 2], 1, "zero"), ["id"], "v", ("q", 0))  # after a newer one
    assert not s.upsert(rows(spark, [1], 1, "again"), ["id"], "v", ("q", 1))
    assert s._numbers()[-1] == version and held(s) == {1: (1, "one1"), 2: (1, "zero2")}
    assert s.upsert(rows(spark, [3], 1), ["id"], "v", ("other", 0)) and s.upsert(rows(spark, [], 1), ["id"], "v", ("q", 2))
    assert s._manifest()[1]["fences"] == {"q": 2, "other": 0}


def test_a_stream_is_fenced_by_its_own_id(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, x string").write.parquet(str(tmp_path / "in"))
    s = store.ChunkStore(spark, str(tmp_path / "c"), 4)
    source = lambda: spark.readStream.schema("id int, v int, x string").parquet(str(tmp_path / "in"))
    run = lambda: sessions.upsert_stream(source(), s, ["id"], "v", str(tmp_path / "cp")).awaitTermination()
    run()
    fences = s._manifest()[1]["fences"]
    assert list(fences.values()) == [0] and len(next(iter(fences))) == 36
    s.delete(F.col("id") == 1)
    # the batch is taken back from the commit log, as if the driver had died before its commit: it is delivered again
    for f in (tmp_path / "cp/commits").iterdir():
        f.unlink()
    run()
    assert [r["id"] for r in s.read().collect()] == [2] and s._manifest()[1]["fences"] == fences
