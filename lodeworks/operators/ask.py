"""Asking in batches: request checks, sessions, cache, the question loop, and what is written back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import elapsed, point_id, should_cache
from lodeworks.operators import agent, memory, retrieval
from lodeworks.operators.shared import written

QUESTION_CHARS = (1, 1000)


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, quarantined ones): a question has 1 to 1000 characters."""
    ok = F.coalesce(F.length("question").between(*QUESTION_CHARS), F.lit(False))
    return requests.filter(ok), requests.filter(~ok)


def session_id(request_id: Column) -> Column:
    """A new session's id. By the request, so that a retried task gives the same one; F.uuid() gives random ones."""
    return point_id(F.lit("session"), request_id, F.lit(0))


def ask_batch(
    requests: DataFrame,
    entries: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    generate: Callable[[DataFrame], DataFrame],
    now: Column,
    least: float = memory.SIMILARITY,
    gated: bool = False,
    hyde: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Answers of valid requests (question_id, question, session_id, vec, and a history as in agent.searched).

    entries: the live cache (entry_id, vec, answer). Hits are answered from it with the route `cache`; the others go
    through the loop. gated: only questions that stand alone may use the cache (the terminal's rule). Returns
    question_id, session_id, question, answer, route, cached, cacheable, asked_at.
    """
    may = should_cache(F.col("question")) if gated else F.lit(True)
    asked = validate(requests)[0].withColumn("session_id", F.coalesce("session_id", session_id(F.col("question_id")))).withColumn("_may", may)
    probes = asked.filter("_may").select(F.col("question_id").alias("probe_id"), "vec")
    hits = written(memory.cache_lookup(probes, entries, least).select(F.col("probe_id").alias("question_id"), "answer"))  # read twice
    kept = ["question_id", "session_id", "question", "answer", "route", "cached", "cacheable"]
    found = asked.join(hits, "question_id").select("question_id", "session_id", "question", "answer", F.lit("cache").alias("route"), F.lit(True).alias("cached"), F.lit(False).alias("cacheable"))
    rest = asked.join(hits, "question_id", "left_anti").drop("vec")
    told = agent.answer(rest, retrieve, generate, hyde).withColumn("cached", F.lit(False)).withColumn("cacheable", (F.col("route") == "rag") & F.col("_may")).select(*kept)
    return found.unionByName(told).withColumn("asked_at", now)


def new_turns(answers: DataFrame) -> DataFrame:
    """The messages that answers append to their sessions."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return answers.select("session_id", "asked_at", F.posexplode(pair).alias("step", "m")).select("session_id", "asked_at", "step", "m.*")


def cache_puts(answers: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entries to put: answers of the route `rag` with their questions' vectors (question_id, vec)."""
    return answers.filter("cacheable").join(vectors.select("question_id", "vec"), "question_id").select("question_id", "question", "vec", "answer", F.col("asked_at").alias("ts"), F.lit(memory.CACHE_TTL_STATIC_S).alias("ttl_s"))


def response_time(answers: DataFrame, done: Column) -> DataFrame:
    return answers.withColumn("response_time", elapsed(F.col("asked_at"), done))


def answer_simple(questions: DataFrame, hits: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Single-shot answers: hits (question_id, rank, source_key, text) of at most five ranks become a context by source, one call answers."""
    part = F.struct("rank", F.concat(F.lit("["), F.coalesce("source_key", F.lit("")), F.lit("]\n"), F.col("text")).alias("t"))
    context = hits.filter(F.col("rank") <= retrieval.SINGLE_SHOT).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("context"))
    out = generate(questions.join(context, "question_id", "left"))
    return out.withColumn("answer", F.when(F.col("context").isNull(), agent.NO_INFORMATION).otherwise(F.col("answer")))


def prompt(context: Column, question: Column) -> Column:
    """The stand-in models' prompt."""
    return F.concat(F.lit("CONTEXT:"), F.coalesce(context, F.lit("")), F.lit("\n\nQUESTION:"), question)


def read_session(turns: DataFrame, sessions: DataFrame, session: str = "conv_id") -> DataFrame:
    """History and message_count of each session asked for; a session without messages has an empty history."""
    found = memory.history(turns.join(sessions.select(session).distinct(), session, "left_semi"), session=session)
    none = F.array().cast("array<struct<role:string,content:string>>")
    out = sessions.select(session).distinct().join(found, session, "left").withColumn("history", F.coalesce("history", none))
    return out.withColumn("message_count", F.size("history"))


def delete_sessions(turns: DataFrame, doomed: DataFrame, session: str = "conv_id") -> DataFrame:
    return turns.join(doomed.select(session).distinct(), session, "left_anti")


def stats(points: DataFrame | None, cache: DataFrame | None) -> DataFrame:
    """One row: the store's points and the cache's live entries; a part that is missing degrades to an error of its own."""
    spark = (points if points is not None else cache).sparkSession
    one = spark.range(1).select(F.lit("ok").alias("status"))
    for name, df in (("points", points), ("entries", cache)):
        n = df.agg(F.count("*").alias(name)) if df is not None else spark.range(1).select(F.lit(None).cast("long").alias(name))
        one = one.join(n, F.lit(True)).withColumn(f"{name}_error", F.lit(None if df is not None else f"no table of {name}").cast("string"))
    return one
