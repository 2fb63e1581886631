import pytest
from pyspark.sql import functions as F

from lodeworks.operators import memory
from lodeworks.streaming import sessions

TURNS = "session_id string, ts timestamp, role string, text string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, sessions.ROCKSDB)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def replay(spark, folder, name, checkpoint, **more):
    src = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(folder)
    q = sessions.session_stream(src, **more).writeStream.format("parquet").option("path", f"{checkpoint}-{name}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert q.exception() is None


def histories(df):
    return {r["session_id"]: [(m["role"], m["text"]) for m in r["history"]] for r in df.collect()}


def test_state_of_a_replayed_table_is_its_session_history(rocks, tmp_path):
    c = rocks.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    # a turn a minute from a start of its own, so no history runs out
    turns = c.select(F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60).alias("ts"), "role", "text")
    cut = F.timestamp_seconds(F.lit(1_704_067_200 + 60 * 3))
    turns.filter(F.col("ts") < cut).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    turns.filter(F.col("ts") >= cut).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    (tmp_path / "src").mkdir()
    for i, part in enumerate("ab"):
        next((tmp_path / "in" / part).glob("*.parquet")).rename(tmp_path / "src" / f"{i}.parquet")
        replay(rocks, str(tmp_path / "src"), "out", str(tmp_path / "cp"))
    want = {str(r["conv_id"]): [(m["role"], m["content"]) for m in r["history"]] for r in memory.history(c).collect()}
    state = sessions.session_state(rocks, str(tmp_path / "cp"))
    assert histories(state) == want
    assert state.filter("message_count <> size(history)").isEmpty() and max(r["message_count"] for r in state.collect()) <= memory.HISTORY_MAX
    first = sessions.session_state(rocks, str(tmp_path / "cp"), batch=0)  # as it was after the first file
    assert histories(first) == {k: v[:3] for k, v in {str(r["conv_id"]): [(m["role"], m["content"]) for m in r["history"]] for r in memory.history(c.filter("turn < 3")).collect()}.items()}


def test_a_stream_goes_on_from_a_batch_table(rocks, tmp_path):
    at = lambda m: f"2024-01-01 10:{m:02d}:00"
    make = lambda rows: rocks.createDataFrame(rows, "session_id string, ts string, role string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    before = make([("a", at(0), "user", "q1"), ("a", at(1), "assistant", "r1"), ("b", at(0), "user", "only before"), ("d", "2024-01-01 01:00:00", "user", "long ago")])
    make([("a", at(5), "user", "q2"), ("c", at(5), "user", "new"), ("d", at(5), "user", "back")]).coalesce(1).write.parquet(str(tmp_path / "src"))
    replay(rocks, str(tmp_path / "src"), "out", str(tmp_path / "cp"), initial=before, most=3)
    assert histories(sessions.session_state(rocks, str(tmp_path / "cp"))) == {
        "a": [("user", "q1"), ("assistant", "r1"), ("user", "q2")],
        "b": [("user", "only before")],
        "c": [("user", "new")],
        "d": [("user", "back")],  # what was beyond the time to live is another history
    }


def test_a_keeper_holds_few_of_many_rows():
    import pandas as pd

    class State(list):
        exists = lambda self: bool(self)
        get = lambda self: iter(self)

    keeper = sessions.SessionKeeper(3_600_000, 4)
    keeper.messages = State()
    part = lambda lo, hi: pd.DataFrame({"ts": pd.to_datetime(range(lo, hi), unit="s"), "role": "user", "text": [f"m{i}" for i in range(lo, hi)]})
    held = keeper._with([part(500, 1000), part(0, 500), part(1000, 1100)])
    assert [x[2] for x in held] == ["m1096", "m1097", "m1098", "m1099"]
    keeper.messages = State(held)
    late = keeper._with([part(9000, 9001)])
    assert [x[2] for x in late] == ["m9000"]
