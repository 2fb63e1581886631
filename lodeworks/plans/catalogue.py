"""Registered queries of the engine's own operators and their SQL, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeworks.functions import models
from lodeworks.functions import text as T
from lodeworks.functions.html import html_udf
from lodeworks.operators import agent, ann, chunking, lexical, memory, metrics, retrieval, store
from lodeworks.operators.shared import bounded_batches, shared_folder
from lodeworks.plans.registry import ORACLE_SQL, QUERIES, query
from lodeworks.session import table
from lodeworks.sources import catalog, exports

_COS = "round(coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0), 6)"


def _vector(v, vec_id):
    """One row's vector as a literal; null, which is like nothing, where there is no such row."""
    found = v.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return F.lit(found[0] if found else None).cast("array<double>")


@query(f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 20")
def dense_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return retrieval.top_k(v, _vector(v, 0))


@query(f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 5")
def single_shot_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return retrieval.top_k(v, _vector(v, 0), retrieval.SINGLE_SHOT)


@query(f"SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id)::INT AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 20")
def dense_topk_batch(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return retrieval.top_k_batch(q, v).select("query_id", "vec_id", "score", "rank")


@query()
def dense_topk_ann(spark, sf):
    """Every hundredth vector against an approximate index of all of them."""
    v = table(spark, sf, "embeddings")
    index = ann.build(v)
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    if index is None:
        return q.limit(0).select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return ann.search(index, q).select("query_id", "vec_id", "score", "rank")


_TOKENS = "SELECT DISTINCT {id}, unnest(string_split_regex(lower(text), '[^\\p{{L}}0-9]+')) AS token FROM {t}"
_OVERLAP = f"WITH q AS ({_TOKENS.format(id='item_id AS query_id', t='benchmark')}), d AS ({_TOKENS.format(id='doc_id', t='documents')}), s AS (SELECT query_id, doc_id, count(*) AS score FROM q JOIN d USING (token) WHERE length(token) >= 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)"


def _overlap(spark, sf, k):
    q = retrieval.tokens(table(spark, sf, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    return retrieval.overlap_top_k(q, table(spark, sf, "documents").select("doc_id", "text"), k)


@query(f"{_OVERLAP} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 20")
def sparse_topk(spark, sf):
    return _overlap(spark, sf, 20).select("query_id", "doc_id", "score", "rank")


@query(rf"{_OVERLAP}, pr AS (SELECT r.query_id, r.doc_id, r.rank, list_distinct(string_split_regex(lower(b.text), '[^\p{{L}}\p{{N}}]+')) AS qt, list_distinct(string_split_regex(lower(d.text), '[^\p{{L}}\p{{N}}]+')) AS dt FROM r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = r.query_id WHERE rank <= 20), sc AS (SELECT query_id, doc_id, rank, len(list_filter(qt, lambda x: x <> '' AND list_contains(dt, x)))::DOUBLE / greatest(len(list_filter(qt, lambda x: x <> '')), 1) AS score, count(*) OVER (PARTITION BY query_id) AS n FROM pr), z AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 3 THEN score END DESC NULLS LAST, rank)::INT AS rerank FROM sc) SELECT * FROM z WHERE rerank <= 3")
def rerank_topn(spark, sf):
    """The 20 best of each benchmark item, ordered anew by a re-ranker's scores of (question, text) pairs."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    pairs = _overlap(spark, sf, 20).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(asked, "query_id")
    scored = pairs.withColumn("score", models.rerank_udf(models.OverlapReranker())("question", "text")).drop("text", "question")
    return retrieval.rerank(scored, F.col("score")).select("query_id", "doc_id", "rank", "rerank")


@query(r"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS terms, CASE WHEN len(w) > 0 THEN 64 ELSE 0 END AS dim FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)")
def encode_documents(spark, sf):
    """Every document's vectors, encoded in batches by length under a budget of tokens."""
    bounded_batches(spark)  # texts vary from one word to books
    out = "doc_id long, text string, dense array<float>, sparse map<string,int>"
    coded = table(spark, sf, "documents").select("doc_id", "text").mapInPandas(models.encode_packed(models.HashEmbedder(64)), out)
    total = F.aggregate(F.map_values("sparse"), F.lit(0), lambda a, x: a + x)
    return coded.select("doc_id", F.coalesce(total, F.lit(0)).cast("long").alias("words"), F.coalesce(F.size(F.map_keys("sparse")), F.lit(0)).cast("long").alias("terms"), F.when(F.col("dense").isNull(), 0).otherwise(F.size("dense")).alias("dim"))


_BM25 = r"""w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}0-9]+')) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM w WHERE token <> '' GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
st AS (SELECT count(*)::DOUBLE AS docs, sum(n)::DOUBLE AS words FROM dl), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(lower(text), '[^\p{L}0-9]+')) AS token FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * n * docs / words))), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 20)"""


def _bm25(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.bm25_batch(q, table(spark, sf, "documents"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(spark, sf):
    return _bm25(spark, sf)


@query(f"WITH {_BM25}, dense AS (SELECT * FROM (SELECT b.item_id AS query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY {_COS} DESC, e.vec_id)::INT AS rank FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)) WHERE rank <= 20), f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (rank + 60)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT * FROM dense) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 10")
def rank_fusion(spark, sf):
    """BM25's list and a dense list of each benchmark item; the vectors with an item's or a document's number stand for its embedding."""
    v = table(spark, sf, "embeddings")
    asked = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    dense = retrieval.top_k_batch(asked, v.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi"), 20)
    both = dense.select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.reciprocal_rank_fusion(_bm25(spark, sf), both, 10).select("query_id", "doc_id", "score", "rank")


@query(f"{_OVERLAP} SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents d USING (doc_id) WHERE rank <= 3 GROUP BY query_id")
def context_assembly(spark, sf):
    return retrieval.assemble_context(_overlap(spark, sf, 3).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))


def _lookup_sql(least):
    return f"SELECT probe_id, entry_id, score, answer FROM (SELECT q.vec_id AS probe_id, e.vec_id AS entry_id, {_COS} AS score, 'a' || e.vec_id AS answer, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id WHERE {_COS} >= {least} AND {_COS} > 0) WHERE r = 1"


def _entries(v):
    return v.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vec"), F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("answer"))


_MOVED = "list_transform(embedding, lambda x, i: CASE WHEN i <= 8 THEN x::DOUBLE + CASE WHEN vec_id % 200 = 0 THEN 0.05 ELSE 0.25 END ELSE x::DOUBLE END)"


@query(f"SELECT probe_id, entry_id, score, answer FROM (SELECT q.vec_id AS probe_id, e.vec_id AS entry_id, {_COS} AS score, 'a' || e.vec_id AS answer, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS r FROM (SELECT vec_id, {_MOVED} AS embedding FROM embeddings WHERE vec_id % 100 = 0) q CROSS JOIN embeddings e WHERE {_COS} >= 0.95 AND {_COS} > 0) WHERE r = 1")
def cache_lookup(spark, sf):
    """Probes are every hundredth vector, moved a little or farther: half of them still meet what they came from."""
    v = table(spark, sf, "embeddings")
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i < 8, F.when(F.col("vec_id") % 200 == 0, 0.05).otherwise(0.25)).otherwise(0.0))
    return memory.cache_lookup(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("probe_id"), moved.alias("vec")), _entries(v))


@query(_lookup_sql(0.35))
def cache_lookup_loose(spark, sf):
    v = table(spark, sf, "embeddings")
    return memory.cache_lookup(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("vec")), _entries(v), 0.35, exclude_own=True)


def _puts(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", F.when(F.col("event_id") % 2 == 0, memory.CACHE_TTL_STATIC_S).otherwise(memory.CACHE_TTL_DYNAMIC_S).alias("ttl_s"))


_PUTS = "SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 86400 ELSE 1800 END AS ttl_s FROM events"
_NOW = "2024-01-15 12:00:00"


@query(f"SELECT event_id, ttl_s FROM ({_PUTS}) WHERE epoch(ts)::BIGINT + ttl_s > epoch(TIMESTAMP '{_NOW}') AND ts <= TIMESTAMP '{_NOW}'")
def cache_expiry(spark, sf):
    return memory.live(_puts(spark, sf), F.lit(_NOW).cast("timestamp")).filter(F.col("ts") <= F.lit(_NOW).cast("timestamp_ntz")).select("event_id", "ttl_s")


@query(f"SELECT ttl_s, count(*) AS live FROM ({_PUTS}) WHERE epoch(ts)::BIGINT + ttl_s > epoch(TIMESTAMP '{_NOW}') AND ts <= TIMESTAMP '{_NOW}' GROUP BY ttl_s")
def cache_stats(spark, sf):
    return cache_expiry(spark, sf).groupBy("ttl_s").agg(F.count("*").alias("live"))


@query(r"SELECT conv_id, turn, 'cache:' || md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS cache_key FROM conversations WHERE role = 'user'")
def cache_key(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", T.cache_key(F.col("text")).alias("cache_key"))


@query("WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || ':' || doc_id || ':0')) AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(to_hex(((('0x' || h[17:17])::INT & 3) | 8)::INT)) || h[18:20] || '-' || h[21:32] AS point_id FROM h")
def point_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.point_id(F.col("source"), F.col("doc_id"), F.lit(0)).alias("point_id"))


#: A made-up assistant's name, its misspellings and the pronoun it leads answers with.
_RULES = T.name_rules("İdil", ["idyl", "[İI]dill"], "Sen")


@query(r"SELECT conv_id, turn, regexp_replace('İdil and İdil of İdil: ' || regexp_replace(text, '^\s+|\s+$', '', 'g') || ' last', '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def clean_answer(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.concat(F.lit("<think>a\nb</think> Sen idyl and IDILL of Idil: "), T.strip("text"), F.lit(" last\n"))
    return c.select("conv_id", "turn", T.clean_answer(said, _RULES).alias("answer"))


_STARTS = " OR ".join(f"starts_with(q, '{k}')" for k in T.CONTEXT_KEYWORDS)


@query(rf"SELECT conv_id, turn, length(q) >= 10 AND NOT ({_STARTS}) AS cacheable FROM (SELECT *, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS q FROM conversations WHERE role = 'user')")
def should_cache(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", T.should_cache(F.col("text")).alias("cacheable"))


@query(r"SELECT conv_id, turn, turn > 0 AND len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) <= 6 AS rewrite FROM conversations WHERE role = 'user'")
def rewrite_gate(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", T.rewrite_gate(F.col("text"), F.col("turn")).alias("rewrite"))


def _history_sql(n):
    return f"SELECT conv_id, count(*) AS messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= {n} GROUP BY conv_id"


def _history(spark, sf, n):
    h = memory.history(table(spark, sf, "conversations"), n)
    return h.select("conv_id", F.size("history").cast("long").alias("messages"), F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("history"))


@query(_history_sql(20))
def session_history(spark, sf):
    return _history(spark, sf, memory.HISTORY_MAX)


@query(_history_sql(4))
def session_history_last4(spark, sf):
    return _history(spark, sf, memory.PROMPT_LAST)


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substring(text, 1, 150), chr(10) ORDER BY turn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 GROUP BY conv_id")
def history_prompt(spark, sf):
    return memory.history_prompt(table(spark, sf, "conversations"))


@query("SELECT conv_id, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_summary(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"))


@query("WITH g AS (SELECT *, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS gap FROM events) SELECT event_id, user_id, sum(CASE WHEN gap IS NULL OR gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g")
def sessionize_ttl(spark, sf):
    return memory.sessionize(table(spark, sf, "events")).select("event_id", "user_id", "session_no")


@query("SELECT page_id, url FROM pages WHERE page_id > 100")
def delta_scan(spark, sf):
    return catalog.delta(table(spark, sf, "pages"), "page_id", 100)[0].select("page_id", "url")


@query("SELECT coalesce(max(page_id), 0) AS max_id FROM pages")
def max_watermark(spark, sf):
    return catalog.max_watermark(table(spark, sf, "pages"), "page_id")


@query("SELECT page_id, url FROM pages ORDER BY page_id DESC LIMIT 20")
def newest_first(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").orderBy(F.desc("page_id")).limit(20)


@query("SELECT page_id // 20 AS page, min(page_id) AS min_id, max(page_id) AS max_id, count(*) AS n FROM pages GROUP BY 1")
def page_id_range(spark, sf):
    return catalog.page_ranges(table(spark, sf, "pages"), "page_id", 20)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content FROM documents GROUP BY text")
def dedup_first_seen(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_latest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("v"), "o_orderkey", "o_totalprice")
    return store.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "v").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 > 0),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE (o_orderkey % 3 > 0 OR o_orderkey % 5 = 0) AND o_custkey % 7 > 0)
SELECT o_orderkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, round(a.o_totalprice::DOUBLE, 2) AS before, round(b.o_totalprice::DOUBLE, 2) AS after FROM a FULL OUTER JOIN b USING (o_orderkey) WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def store_changes(spark, sf):
    """What an upsert and a delete changed in a stored table, between two of its versions."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    kept = store.ChunkStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", 16)
    kept.upsert(o.filter("o_orderkey % 3 > 0").withColumn("v", F.lit(1)), ["o_orderkey"], "v")
    first = kept._numbers()[-1]
    kept.upsert(o.filter("o_orderkey % 5 = 0").withColumn("o_totalprice", (F.col("o_totalprice") + 1).cast(o.schema["o_totalprice"].dataType)).withColumn("v", F.lit(2)), ["o_orderkey"], "v")
    kept.delete(F.col("o_custkey") % 7 == 0)
    price = lambda c: F.round(F.col(c)["o_totalprice"].cast("double"), 2).alias(c)
    return kept.changes(first, kept._numbers()[-1]).select("o_orderkey", "change", price("before"), price("after"))


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src1'")
def delete_by_key(spark, sf):
    return store.delete_where(table(spark, sf, "documents").select("doc_id", "source"), F.col("source") == "src1")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_linenumber <= (SELECT count(*) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_quantity > 10)")
def prune_stale(spark, sf):
    li = table(spark, sf, "lineitem").select(F.lit("k").alias("source_key"), F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("chunk_index"), "l_quantity")
    now = li.groupBy("source_key", "doc_id").agg(F.count_if(F.col("l_quantity") > 10).alias("total_chunks"))
    return store.prune_stale(li, now).select(F.col("doc_id").alias("l_orderkey"), (F.col("chunk_index") + 1).alias("l_linenumber"))


@query("SELECT count(*) AS points, count(embedding) AS vectors FROM embeddings")
def collection_info(spark, sf):
    return store.info(table(spark, sf, "embeddings"), "embedding")


@query(r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content FROM documents WHERE length(text) <= 1000 AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 80 AND NOT starts_with(text, '#') AND NOT contains(text, chr(10) || '#')")
def chunk_short_docs(spark, sf):
    return chunking.short_chunks(table(spark, sf, "documents")).select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("content"))


@query()
def chunk_documents(spark, sf):
    return chunking.chunk_table(table(spark, sf, "documents"), F.col("text"), F.col("source"), F.col("doc_id"))


@query()
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_udf("https://example.com")("html").alias("h")).select("page_id", "h.text", F.size("h.pdf_links").alias("n_pdf"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS n_links FROM pages")
def distinct_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))).cast("long").alias("n_links"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_INNER = "CASE WHEN left(ltrim(text), 1) = '{0}' THEN TRY_CAST(text AS JSON) ->> '{1}' END"


@query(f"SELECT doc_id, coalesce({_INNER.format('[', '$[0].text')}, {_INNER.format('{', '$.text')}, text, '') AS picked FROM documents")
def json_field_pick(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.json_field_pick(F.to_json(F.struct(F.lit("").alias("text"), F.col("text").alias("content")))).alias("picked"))


@query("SELECT c_custkey, concat_ws(' | ', c_name, c_mktsegment, n_name, 'Görev: ' || r_name, 'Tel: ' || c_nationkey) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def staff_to_text(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", T.staff_line(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name"), F.col("r_name"), F.lit(""), F.col("c_nationkey").cast("string")).alias("line"))


_SKIP = " AND ".join(f"NOT contains(url, '{s}')" for s in T.SKIPPED_LINKS)


@query(f"SELECT page_id, starts_with(url, 'http') AND {_SKIP} AS admissible FROM pages")
def link_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.link_admissible(F.col("url")).alias("admissible"))


@query(f"WITH u AS (SELECT page_id % 50 AS grp, url, min(page_id) AS first FROM pages WHERE starts_with(url, 'http') AND {_SKIP} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY first) AS r FROM u) SELECT grp, string_agg(url, ' ' ORDER BY first) AS links FROM r WHERE r <= 3 GROUP BY grp")
def source_links(spark, sf):
    """Admissible links of each group, distinct by first page, three at most: cut to those before any are gathered."""
    p = table(spark, sf, "pages").filter(T.link_admissible(F.col("url"))).groupBy((F.col("page_id") % 50).alias("grp"), "url").agg(F.min("page_id").alias("first"))
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("first"))).filter(F.col("r") <= retrieval.SHOWN_LINKS)
    links = F.array_sort(F.collect_list(F.struct("r", "url")))
    return p.groupBy("grp").agg(F.array_join(F.transform(links, lambda x: x["url"]), " ").alias("links"))


_GREET = " OR ".join(f"starts_with(q, '{g}')" for g in agent.GREETINGS)
_WORDS = "len(list_filter(string_split_regex(q, '\\s+'), lambda x: x <> ''))"


@query(rf"SELECT conv_id, turn, CASE WHEN ({_GREET}) AND NOT regexp_matches(q, '\b(what|who|when|where|why|how|which)\b') AND {_WORDS} <= 4 THEN 'direct' ELSE 'rag' END AS route FROM (SELECT *, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS q FROM conversations WHERE role = 'user')")
def route_questions(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", agent.route(F.col("text")).alias("route"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'useful' ELSE 'not_useful' END AS grade FROM documents JOIN labels USING (doc_id)")
def grade_quality(spark, sf):
    reply = F.when(F.col("quality") == 1, " Useful\n").otherwise("not_useful")
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id").select("doc_id", agent.grade(reply).alias("grade"))


@query("SELECT doc_id, CASE WHEN quality = 1 OR doc_id % 3 >= 2 THEN 'end' ELSE 'retry' END AS decision FROM labels")
def grade_decision(spark, sf):
    verdict = F.when(F.col("quality") == 1, "useful").otherwise("not_useful")
    return table(spark, sf, "labels").select("doc_id", agent.decide(verdict, F.col("doc_id") % 3).alias("decision"))


@query("SELECT event_type, user_id, count(*) AS value FROM events GROUP BY ALL")
def metric_counter(spark, sf):
    return metrics.counter(table(spark, sf, "events"), ["event_type", "user_id"])


@query("SELECT event_type, " + ", ".join(f"sum(CASE WHEN value / 10 <= {b} THEN 1 ELSE 0 END)::BIGINT AS le_{str(b).replace('.', '_')}" for b in metrics.BUCKETS) + ", count(value) AS le_inf, round(sum(value / 10), 4) AS sum, count(value) AS count FROM events GROUP BY event_type")
def metric_histogram(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), ["event_type"], F.col("value") / 10)


@query("SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def metric_gauge(spark, sf):
    return metrics.gauge(table(spark, sf, "events"), ["event_type"], "value", "ts", "event_id")


@query("WITH t AS (SELECT event_id, timezone('Europe/Istanbul', timezone('UTC', ts)) AS z FROM events) SELECT event_id, 'daily' AS frequency FROM t WHERE hour(z) = 2 UNION ALL SELECT event_id, 'weekly' FROM t WHERE hour(z) = 3 AND isodow(z) = 1 UNION ALL SELECT event_id, 'monthly' FROM t WHERE hour(z) = 4 AND day(z) = 1")
def due_targets(spark, sf):
    return catalog.due(table(spark, sf, "events").select("event_id", "ts")).select("event_id", "frequency")


_WALL = "timezone('Europe/Istanbul', timezone('UTC', {0}))"
_FIRES = "CASE frequency WHEN 'daily' THEN date_trunc('day', {0} - INTERVAL 2 HOUR) + INTERVAL 2 HOUR WHEN 'weekly' THEN date_trunc('week', {0} - INTERVAL 3 HOUR) + INTERVAL 3 HOUR ELSE date_trunc('month', {0} - INTERVAL 4 HOUR) + INTERVAL 4 HOUR END"
_SINCE = "CASE frequency WHEN 'daily' THEN date_diff('day', b, a) WHEN 'weekly' THEN date_diff('day', b, a) // 7 ELSE date_diff('month', b, a) END"


@query(f"""WITH runs AS (SELECT ['daily', 'weekly', 'monthly'][user_id % 3 + 1] AS frequency, ts FROM events WHERE event_type = 'click' AND event_id % 50 = 0),
t AS (SELECT event_id, e.ts, f.frequency FROM events e CROSS JOIN (SELECT unnest(['daily', 'weekly', 'monthly']) AS frequency) f WHERE event_type <> 'click'),
j AS (SELECT t.event_id, t.ts, t.frequency, runs.ts AS last_run FROM t ASOF LEFT JOIN runs ON t.frequency = runs.frequency AND t.ts >= runs.ts),
k AS (SELECT *, {_FIRES.format(_WALL.format('ts'))} AS a, {_FIRES.format(_WALL.format('last_run'))} AS b FROM j),
m AS (SELECT event_id, frequency, CASE WHEN last_run IS NULL THEN 1 ELSE {_SINCE} END::BIGINT AS missed, (floor(epoch(ts)) - epoch(timezone('UTC', timezone('Europe/Istanbul', a))))::BIGINT AS late_s FROM k)
SELECT *, missed > 0 AND late_s <= CASE frequency WHEN 'monthly' THEN 7200 ELSE 3600 END AS run FROM m""")
def missed_runs(spark, sf):
    """Clicks with every fiftieth number are the run log, all other events the ticks."""
    e = table(spark, sf, "events")
    job = F.element_at(F.array(*(F.lit(x[0]) for x in catalog.SCHEDULE)), (F.col("user_id") % 3 + 1).cast("int"))
    log = e.filter("event_type = 'click' AND event_id % 50 = 0").select(job.alias("frequency"), "ts")
    return catalog.missed_runs(e.filter("event_type <> 'click'").select("event_id", "ts"), log).select("event_id", "frequency", "missed", "late_s", "run")


@query(r"SELECT page_id, CASE WHEN f = '' THEN 'document' ELSE f END AS name FROM (SELECT page_id, regexp_replace(split_part(list_last(string_split(url, '/')), '?', 1), '[^\w.\-]', '_', 'g') AS f FROM pages)")
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query("SELECT conv_id, turn, text AS instruction, '' AS input, output FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS output FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'")
def to_alpaca(spark, sf):
    return exports.alpaca(table(spark, sf, "conversations"))


@query()
def to_sharegpt(spark, sf):
    return exports.sharegpt(table(spark, sf, "conversations"))


@query(r"SELECT doc_id, count(*) AS n_terms, sum(n)::BIGINT AS n_words FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}0-9]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL) GROUP BY doc_id")
def sparse_terms(spark, sf):
    """Lexical weights of each text, summed up: an inverted list with one row a term and text."""
    words = F.explode(F.array_remove(F.split(F.lower(F.col("text")), r"[^\p{L}0-9]+"), ""))
    each = table(spark, sf, "documents").select("doc_id", words.alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_words"))


@query("SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS attachments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def listing_detail_join(spark, sf):
    """Listing items with the number of their attachments: details are summed up before the join."""
    d = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(d, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("attachments"))


@query()
def agent_answers(spark, sf):
    """The question loop over every benchmark question: top 20 by overlap, re-ranked to 3 by their best sentence, with extractive answers.

    Documents have no links and benchmark questions no history, so neither plays a part here.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def retrieve(q):
        found = retrieval.overlap_top_k(retrieval.tokens(q, "question_id", "search").withColumnRenamed("question_id", "query_id"), docs, retrieval.RETRIEVE)
        hits = found.join(docs, "doc_id").join(q.select(F.col("question_id").alias("query_id"), "search"), "query_id")
        best = retrieval.rerank(hits, agent.best_overlap(F.col("search"), F.col("text")))
        return q.join(retrieval.assemble_context(best, rank="rerank").withColumnRenamed("query_id", "question_id"), "question_id", "left")

    generate = lambda q: q.withColumn("answer", agent.best_sentence(F.col("question"), F.col("context")))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return agent.answer(asked, retrieve, generate).select("question_id", "route", "grade", "iterations", "answer")


from lodeworks.plans import asking, ingest  # noqa: E402, F401 - they register their queries
