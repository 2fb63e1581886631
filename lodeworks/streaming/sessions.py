"""Streams: session state with a time to live, cache de-duplication, idempotent upserts."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodeworks.operators.memory import HISTORY_MAX, SESSION_TTL_S
from lodeworks.operators.store import ChunkStore


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MESSAGE = "ts long, role string, text string"
_OUT = "session_id string, history array<struct<role:string,text:string>>, message_count int, expired boolean"


class SessionKeeper(StatefulProcessor):
    """A session's last messages as list state; an event-time timer at the last write plus the time to live ends it."""

    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", _MESSAGE)

    def handleInitialState(self, key, initialState, timerValues):
        """Messages of before the stream, in one part or several: its first batch goes on from them."""
        self._put(self._with([initialState]), timerValues)

    def handleInputRows(self, key, rows, timerValues):
        held = self._with(rows)
        self._put(held, timerValues)
        yield self._row(key, held, False)

    def _with(self, rows) -> list[tuple]:
        """The last messages of state and rows, a bounded heap of them; those before a gap beyond the time to live are another history."""
        held = [tuple(x) for x in self.messages.get()] if self.messages.exists() else []
        for pdf in rows:
            held = heapq.nlargest(self.most, [*held, *((int(t.timestamp() * 1000), r, x) for t, r, x in zip(pdf["ts"], pdf["role"], pdf["text"]))])
        held = sorted(held)[-self.most :]
        gaps = [i for i in range(1, len(held)) if held[i][0] - held[i - 1][0] > self.ttl_ms]
        return held[gaps[-1] :] if gaps else held

    def _put(self, held, timerValues) -> None:
        self.messages.put(held)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(held[-1][0] + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [tuple(x) for x in self.messages.get()]
        self.messages.clear()
        yield self._row(key, held, True)

    def _row(self, key, held, expired):
        return pd.DataFrame({"session_id": [key[0]], "history": [[{"role": r, "text": x} for _, r, x in held]], "message_count": [len(held)], "expired": [expired]})

    def close(self) -> None:
        pass


def session_stream(turns: DataFrame, ttl_s: int = SESSION_TTL_S, most: int = HISTORY_MAX, delay: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """The history of each session after each batch that writes to it, and a last row as it runs out.

    turns: session_id, ts, role, text; initial: the same of a batch table, the state that the stream begins with. The time to live
    runs from the last write, in event time; the last `most` messages stay. The session must use the RocksDB state store (ROCKSDB).
    """
    columns = lambda df: df.select("session_id", F.col("ts").cast("timestamp").alias("ts"), "role", "text")
    rows = columns(turns).withWatermark("ts", delay)
    begun = columns(initial).groupBy("session_id") if initial is not None else None
    return rows.groupBy("session_id").transformWithStateInPandas(SessionKeeper(ttl_s * 1000, most), _OUT, "Append", "EventTime", begun)


def session_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """What a session stream remembers, from its checkpoint alone, after its newest batch or that of a number: session_id,
    history array<struct<role, text>> (oldest first), message_count and last_ts. The stream may go on meanwhile."""
    state = spark.read.format("statestore").option("stateVarName", "messages")
    state = (state.option("batchId", batch) if batch is not None else state).load(checkpoint)
    parts = F.array_sort(F.collect_list(F.struct(F.col("list_element.ts").alias("ts"), F.col("list_element.role").alias("role"), F.col("list_element.text").alias("text"))))
    held = state.groupBy(F.col("key.session_id").alias("session_id")).agg(parts.alias("m"))
    return held.select("session_id", F.transform("m", lambda m: F.struct(m["role"], m["text"])).alias("history"), F.size("m").alias("message_count"), F.timestamp_millis(F.array_max(F.transform("m", lambda m: m["ts"]))).alias("last_ts"))


def first_puts(puts: DataFrame, key: str, ttl: str = "30 minutes") -> DataFrame:
    """Puts of a key again within the watermark are dropped."""
    return puts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def upsert_stream(rows: DataFrame, store: ChunkStore, key: list[str], version: str, checkpoint: str):
    """Each batch is upserted by key, fenced by the query's id and the batch's number: one that is delivered again, or
    after a newer one, changes nothing. The id lives in the checkpoint, so it outlasts restarts."""

    def put(df: DataFrame, batch: int) -> None:
        store.upsert(df, key, version, (df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), batch))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
