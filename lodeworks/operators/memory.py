"""Session history and the semantic answer cache, over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import epoch_seconds

SESSION_TTL_S, HISTORY_MAX, PROMPT_LAST, PROMPT_CHARS = 7200, 20, 4, 150
CACHE_TTL_STATIC_S, CACHE_TTL_DYNAMIC_S, SIMILARITY = 86400, 1800, 0.95


def last_messages(turns: DataFrame, n: int = HISTORY_MAX, session: str = "conv_id", order: str = "turn") -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def history(turns: DataFrame, n: int = HISTORY_MAX, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row a session: its last n messages as array<struct<role, content>>, oldest first."""
    kept = last_messages(turns, n, session, order)
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content"))))
    return kept.groupBy(session).agg(F.transform(items, lambda m: F.struct(m["role"], m["content"])).alias("history"))


def history_prompt(turns: DataFrame, n: int = PROMPT_LAST, chars: int = PROMPT_CHARS) -> DataFrame:
    kept = last_messages(turns, n)
    label = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    items = F.array_sort(F.collect_list(F.struct("turn", F.concat(label, F.substring("text", 1, chars)).alias("line"))))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(items, lambda m: m["line"]), "\n").alias("prompt"))


def sessionize(events: DataFrame, user: str = "user_id", ts: str = "ts", ttl_s: int = SESSION_TTL_S) -> DataFrame:
    """Adds session_no: a write more than ttl_s whole seconds after the one before starts a new history."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    gap = epoch_seconds(F.col(ts)) - epoch_seconds(F.lag(ts).over(w))
    return events.withColumn("_new", F.when(gap.isNull() | (gap > ttl_s), 1).otherwise(0)).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def live(entries: DataFrame, now: Column) -> DataFrame:
    """Entries (put at ts, ttl_s) that have not run out at `now`, in whole seconds, the nearest ones."""
    return entries.filter(epoch_seconds(F.col("ts")) + F.col("ttl_s") > epoch_seconds(now))


def latest_puts(entries: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last put of each key, from maxima with partial aggregation."""
    cols = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max(F.struct(ts, tie, *(c for c in cols if c not in (ts, tie)))).alias("_m")).select(key, "_m.*").select(*entries.columns)


def cache_lookup(probes: DataFrame, entries: DataFrame, least: float = SIMILARITY, exclude_own: bool = False) -> DataFrame:
    """probes (probe_id, vec) with the live entry (entry_id, vec, answer) of highest cosine, if it is at least `least` and
    positive; ties go to the smaller entry. exclude_own: an entry with the probe's own id is no candidate.

    Only ids and vectors meet, in rings around pivots that the threshold leaves in reach; answers are joined to the hits.
    """
    from lodeworks.operators.threshold import nearest_within

    e = entries.filter(F.col("answer").isNotNull() & (F.col("answer") != ""))
    hits = nearest_within(probes.select("probe_id", "vec"), e.select("entry_id", "vec"), least, exclude_own)
    return hits.join(e.select("entry_id", "answer"), "entry_id").select("probe_id", "entry_id", "score", "answer")
