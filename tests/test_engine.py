import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.functions.html import html_to_text
from lodeworks.functions.models import HashEmbedder, embed_udf
from lodeworks.operators import agent, chunking, memory, metrics, retrieval, store
from lodeworks.sources import catalog, exports, listing


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr).first()[0]


@pytest.mark.parametrize("key,doc,i", [("src", "123", "0"), ("faq", "sss:İş", "4")])
def test_point_id_is_uuid5(spark, key, doc, i):
    assert one(spark, T.point_id(F.col("a"), F.col("b"), F.col("c")), a=key, b=doc, c=i) == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{key}:{doc}:{i}"))


def test_text_rules(spark):
    assert one(spark, T.cache_key(F.col("a")), a="\t Some Text\n") == "cache:" + hashlib.md5(b"some text").hexdigest()
    assert one(spark, T.clean_answer(F.col("a"), [(r"(?mU)^You\s+", "")]), a="<think>x\ny</think>You see  ") == "see"
    assert one(spark, T.should_cache(F.col("a")), a="short") is False
    assert one(spark, T.should_cache(F.col("a")), a="other question here") is False
    assert one(spark, T.should_cache(F.col("a")), a="When is the deadline") is True
    assert one(spark, T.safe_filename(F.col("a")), a="https://e.org/f/a b.pdf?v=1") == "a_b.pdf"
    assert one(spark, T.json_body(F.col("a")), a="<pre class=x>{&quot;&lt;&amp;}</pre>") == "{&quot;<&}"
    assert one(spark, T.json_field_pick(F.col("a")), a='{"text": "", "content": "[{\\"text\\": \\"in\\"}]"}') == "in"
    assert one(spark, T.staff_line(*(F.col(x) for x in "abcdef")), a="N", b="", c="U", d="", e="m", f="") == "N | U | E-posta: m"
    gate = lambda q, n: one(spark, T.rewrite_gate(F.col("a"), F.lit(n)), a=q)
    assert (gate("a b", 0), gate("a b c d e f", 2), gate("a b c d e f g", 2)) == (False, True, False)


def test_html():
    assert html_to_text('<p>x <a href="/f/a.PDF?v=1">Form</a></p>', "https://e.org") == ("x  Form [PDF]", ["https://e.org/f/a.PDF?v=1"])
    assert html_to_text('<a href="https://e.org/a">Site</a>')[0] == "Site (https://e.org/a)"
    assert html_to_text('<a href="https://e.org/a">https://e.org/a</a>')[0] == "https://e.org/a"
    assert html_to_text("a<br>b")[0] == "a\nb" and html_to_text("A&nbsp;B")[0] == "AB"
    assert html_to_text("<script>var t='</p>'</script><style>p</style><!-- c --><p>k")[0] == "k"
    assert html_to_text(None) == ("", []) and html_to_text("  ") == ("", [])


def test_chunks():
    assert [len(chunking.chunk_text("a" * n)) for n in (0, 79, 80, 1000)] == [0, 0, 1, 1]
    assert [len(x) for x in chunking.chunk_text("a" * 1001)] == [1000, 151]
    long = ("A sentence of some words. " * 20 + "\n\n") * 9
    parts = chunking.chunk_text(long)
    assert all(80 <= len(p) <= 1000 for p in parts) and len(parts) > 4
    head = "# A\n" + "x" * 90 + "\n## B\n### C\n" + "y" * 90 + "\n```\n# no\n```"
    assert len(chunking.chunk_text(head)) == 2 and chunking.chunk_text(None) == []


def test_chunk_table_and_announcements(spark):
    d = spark.createDataFrame([(1, "s", "z" * 1500), (2, "s", None)], "id long, src string, text string")
    rows = chunking.chunk_table(d, F.col("text"), F.col("src"), F.col("id")).collect()
    assert [r["chunk_index"] for r in rows] == [0, 1] and {r["total_chunks"] for r in rows} == {2}
    a = spark.createDataFrame([(5, "T", "body", [("u", "pdf", "att"), ("u", "pdf", None)])], "id long, title string, content string, attachments array<struct<url:string,type:string,content:string>>")
    assert {(r["doc_id"], r["text"]) for r in chunking.announcement_rows(a).collect()} == {("5", "T\n\nbody"), ("5_att0", "T (Ek 1)\n\natt")}


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in retrieval.top_k(v, F.lit([1.0, 0.0]), 3).collect()] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    few = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9)], "query_id int, rank int, s double")
    assert [r["rank"] for r in retrieval.rerank(few, F.col("s")).orderBy("rerank").collect()] == [1, 2]
    many = spark.createDataFrame([(1, i, float(i % 2)) for i in range(1, 21)], "query_id int, rank int, s double")
    assert [r["rank"] for r in retrieval.rerank(many, F.col("s")).orderBy("rerank").collect()] == [1, 3, 5]
    links = spark.createDataFrame([(["http://a", "http://a", "ftp://b", "http://x?type=get", "http://c", "http://d", "http://e"],)], "l array<string>")
    assert links.select(retrieval.source_links(F.col("l"))).first()[0] == ["http://a", "http://c", "http://d"]
    emb = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string").select(embed_udf(HashEmbedder(16))("t")).collect()
    assert emb[0] == emb[1] and len(emb[0][0]) == 16


def test_agent(spark):
    grade = lambda x, **k: one(spark, agent.grade(F.col("a"), **k), a=x)
    assert [grade(x) for x in (" Useful", "not_useful", "hm")] == ["useful", "not_useful", "not_useful"]
    assert grade("not_useful", compat_substring=True) == "useful"
    assert [one(spark, agent.decide(F.col("a"), F.lit(n)), a=g) for g, n in (("useful", 1), ("not_useful", 1), ("not_useful", 2))] == ["end", "retry", "end"]
    q = spark.createDataFrame([(1, "hello there"), (2, "what is the exam date"), (3, "what of nothing")], "question_id int, question string")
    retrieve = lambda df: df.withColumn("context", F.when(F.col("question_id") == 2, "the exam date is May"))
    rows = {r["question_id"]: r for r in agent.answer(q, retrieve, lambda df: df.withColumn("answer", F.coalesce("context", F.lit("hello")))).collect()}
    assert (rows[1]["route"], rows[2]["grade"], rows[3]["answer"], rows[3]["iterations"]) == ("direct", "useful", agent.NO_INFORMATION, 2)


def test_store(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "chunks"))
    rows = lambda n, v: spark.createDataFrame([("k", "d", i, v, n) for i in range(n)], "source_key string, doc_id string, chunk_index int, v int, total_chunks int")
    s.upsert(rows(5, 1), ["source_key", "doc_id", "chunk_index"], "v")
    s.upsert(rows(3, 2), ["source_key", "doc_id", "chunk_index"], "v")
    s.upsert(rows(3, 2), ["source_key", "doc_id", "chunk_index"], "v")
    assert s.read().count() == 5
    left = store.prune_stale(s.read(), rows(3, 2).select("source_key", "doc_id", "total_chunks").distinct())
    assert sorted(r["chunk_index"] for r in left.collect()) == [0, 1, 2]
    s.delete(F.col("source_key") == "k")
    assert s.read().count() == 0


def test_memory_and_metrics(spark):
    turns = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(22)], "conv_id string, turn int, role string, text string")
    assert [m["content"] for m in memory.history(turns).first()["history"]] == [f"m{i}" for i in range(2, 22)]
    assert memory.history_prompt(turns).first()["prompt"].count("\n") == 3
    ev = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 02:00:00"), (3, 1, "2024-01-01 04:00:01")], "event_id int, user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["session_no"] for r in memory.sessionize(ev).orderBy("event_id").collect()] == [1, 1, 2]
    h = metrics.histogram(spark.createDataFrame([("a", 0.1), ("a", 0.3), ("a", 31.0)], "l string, v double"), ["l"], F.col("v")).first()
    assert [h[f"le_{x}"] for x in ("0_1", "0_25", "0_5", "30_0", "inf")] == [1, 1, 2, 2, 3]
    puts = spark.createDataFrame([("k", 1, 1, "x"), ("k", 2, 2, "y")], "key string, ts int, id int, v string")
    assert memory.latest_puts(puts, "key", "ts", "id").first()["v"] == "y"
    assert json.loads(exports.sharegpt(turns.filter("turn < 2")).first()["conversations"])[1] == {"from": "gpt", "value": "m1"}


def test_sources_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/page_1.json").write_text(json.dumps([{"id": 9, "title": "n"}, {"id": 8}, {"title": "lost"}]))
    (tmp_path / "in/page_2.json").write_text(json.dumps([{"id": 7}]))
    new, lost = catalog.delta(spark.createDataFrame([(9,), (8,), (None,)], "id long"), "id", 8)
    assert new.count() == 1 and lost.count() == 1
    listing.register(spark)
    q = spark.readStream.format("listing").option("folder", str(tmp_path / "in")).load().writeStream.format("memory").queryName("listed").trigger(processingTime="1 second").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.sql("select id from listed").collect()) == [7, 8, 9]
    t = catalog.catalogue(spark, [{"key": "a", "url": "u", "crawl_type": "pdf", "frequency": "daily"}])
    assert t.first()["priority"] == 1
    from lodeworks.streaming import sessions

    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "id int, v int, x string").write.parquet(str(tmp_path / "rows"))
    s = store.ChunkStore(spark, str(tmp_path / "store"))
    src = spark.readStream.schema("id int, v int, x string").parquet(str(tmp_path / "rows"))
    sessions.upsert_stream(src, s, ["id"], "v", str(tmp_path / "cp")).awaitTermination()
    assert [r["x"] for r in s.read().collect()] == ["b"]


def test_registered_queries_have_sql():
    from lodeworks.plans import catalogue

    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"chunk_documents", "html_to_text", "to_sharegpt", "agent_answers", "dense_topk_ann"}
