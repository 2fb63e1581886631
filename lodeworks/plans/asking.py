"""Registered queries of the ask flow, sessions and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import agent, ask, memory, retrieval
from lodeworks.plans.catalogue import _COS, _OVERLAP, _PUTS, _overlap, _puts
from lodeworks.plans.registry import query
from lodeworks.session import table

_LEAST = 0.35
_HITS = f"hits AS (SELECT question_id, answer FROM (SELECT q.vec_id AS question_id, 'a' || e.vec_id AS answer, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id AND q.vec_id IN (SELECT item_id FROM benchmark) WHERE {_COS} >= {_LEAST}) WHERE r = 1)"


def _ask(spark, sf):
    """Benchmark questions with the vector of their number; the cache holds the other vectors' answers; else the three best documents' ids."""
    v = table(spark, sf, "embeddings")
    asked = table(spark, sf, "benchmark").join(v, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("session_id"), F.col("embedding").alias("vec"))
    taken = asked.select(F.col("question_id").alias("vec_id"))
    entries = v.join(F.broadcast(taken) if taken.limit(10_001).count() <= 10_000 else taken, "vec_id", "left_anti").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vec"), F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("answer"))
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def retrieve(q):
        found = retrieval.overlap_top_k(retrieval.tokens(q, "question_id", "search").withColumnRenamed("question_id", "query_id"), docs, retrieval.RERANK)
        context = retrieval.assemble_context(found.withColumn("text", F.col("doc_id").cast("string")))
        return q.join(context.withColumnRenamed("query_id", "question_id"), "question_id", "left")

    return ask.ask_batch(asked, entries, retrieve, lambda q: q.withColumn("answer", F.col("context")), F.lit("2024-01-15 12:00:00").cast("timestamp"), _LEAST)


_ASK = f"""{_OVERLAP}, {_HITS.replace("e.vec_id <> q.vec_id", "e.vec_id NOT IN (SELECT item_id FROM benchmark)")},
found AS (SELECT query_id, string_agg('[' || rank || '] ' || doc_id, chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY query_id),
asked AS (SELECT item_id, b.text AS question, h.answer AS hit, f.context FROM benchmark b JOIN embeddings ON vec_id = item_id LEFT JOIN hits h ON h.question_id = item_id LEFT JOIN found f ON f.query_id = item_id WHERE length(b.text) BETWEEN 1 AND 1000),
answers AS (SELECT item_id AS question_id, question, coalesce(hit, context, '{agent.NO_INFORMATION}') AS answer, CASE WHEN hit IS NULL THEN 'rag' ELSE 'cache' END AS route, hit IS NOT NULL AS cached FROM asked)"""


@query(f"{_ASK} SELECT question_id, answer, route, cached FROM answers")
def ask_batch(spark, sf):
    return _ask(spark, sf).select("question_id", "answer", "route", "cached")


@query(f"{_ASK} SELECT question_id, 0 AS step, 'user' AS role, question AS text FROM answers UNION ALL SELECT question_id, 1, 'assistant', answer FROM answers")
def ask_turns(spark, sf):
    said = _ask(spark, sf)
    ids = said.select("session_id", "question_id")
    return ask.new_turns(said).join(ids, "session_id").select("question_id", "step", "role", "text")


@query(f"{_ASK} SELECT question_id, answer, 86400 AS ttl_s FROM answers WHERE route = 'rag'")
def ask_cache_puts(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec"))
    return ask.cache_puts(_ask(spark, sf), v).select("question_id", "answer", "ttl_s")


@query("SELECT doc_id, length(text) BETWEEN 1 AND 1000 AS valid FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, false FROM documents WHERE text IS NULL")
def request_validation(spark, sf):
    good, bad = ask.validate(table(spark, sf, "documents").select("doc_id", F.col("text").alias("question")))
    return good.select("doc_id", F.lit(True).alias("valid")).unionByName(bad.select("doc_id", F.lit(False).alias("valid")))


@query(f"{_OVERLAP} SELECT query_id AS question_id, string_agg('[' || coalesce(source, '') || ']' || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) AS answer FROM r JOIN documents d USING (doc_id) WHERE rank <= 5 GROUP BY query_id")
def answer_simple(spark, sf):
    hits = _overlap(spark, sf, retrieval.SINGLE_SHOT).join(table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("source_key")), "doc_id").withColumnRenamed("query_id", "question_id")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    out = ask.answer_simple(asked, hits, lambda q: q.withColumn("answer", F.col("context")))
    return out.filter(F.col("context").isNotNull()).select("question_id", "answer")


@query("SELECT conv_id, count(*) FILTER (r <= 20)::INT AS message_count FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) GROUP BY conv_id UNION ALL SELECT max(conv_id) + 1, 0 FROM conversations")
def session_read(spark, sf):
    turns = table(spark, sf, "conversations")
    sessions = turns.select("conv_id").unionByName(turns.agg((F.max("conv_id") + 1).alias("conv_id")))
    return ask.read_session(turns, sessions).select("conv_id", "message_count")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn > 2)")
def session_delete(spark, sf):
    turns = table(spark, sf, "conversations")
    return ask.delete_sessions(turns, turns.filter("turn > 2")).select("conv_id", "turn")


@query(f"SELECT 'ok' AS status, (SELECT count(*) FROM embeddings) AS points, (SELECT count(*) FROM ({_PUTS}) WHERE epoch(ts)::BIGINT + ttl_s > epoch(TIMESTAMP '2024-01-15 12:00:00')) AS entries")
def stats(spark, sf):
    live = memory.live(_puts(spark, sf), F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return ask.stats(table(spark, sf, "embeddings"), live).select("status", "points", "entries")


@query(r"SELECT conv_id, turn, CASE WHEN n = 0 OR n > 200 THEN 'kept' ELSE 'rewritten' END AS took FROM (SELECT *, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM conversations)")
def rewrite_sanity(spark, sf):
    got = T.rewrite_or_original(F.col("text"), F.lit("\x00"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(got == "\x00", "kept").otherwise("rewritten").alias("took"))
