import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import models, parsing
from lodeworks.functions import text as T
from lodeworks.functions.html import html_to_text, pruned
from lodeworks.operators import ask, chunking, memory, metrics, retrieval, store
from lodeworks.sources import catalog, pages


@pytest.mark.parametrize(
    "html,text",
    [
        ("<html><head><title>t</title><body><p>text</p></body></html>", "text"),
        ("<head><meta charset=x><style>p{}</style><p>a", "a"),
        ("<p>one<p>two", "one\ntwo"),
        ("<li>a<li>b", "a\nb"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>d", "a b\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>x", "a b\nc\nx"),
        ("<div><p>a</div>b", "a\nb"),
        ("<p>a<div>b</div>c", "a\nb\nc"),
        ("a</p>b</li>", "a b"),
    ],
)
def test_omitted_end_tags(html, text):
    assert html_to_text(html)[0] == text


def test_a_link_ends_where_the_next_begins():
    assert html_to_text('<a href="/x">A<a href="/y.pdf">B</a>', "http://e") == ("A (http://e/x) B [PDF]", ["http://e/y.pdf"])


def test_pruned_lines():
    assert pruned("Home\nA line of six plain words\nx (http://e.org/aaaaaaaaaaaaaaaaaaaaaa) y z w v") == "A line of six plain words"


def test_chunks_are_stripped():
    assert chunking.chunk_text("  " + "a" * 90 + "\n") == ["a" * 90]


def test_names_in_answers(spark):
    rules = T.name_rules("İdil", ["idyl", "[İI]dill"], "Sen")
    clean = lambda x: spark.createDataFrame([(x,)], "a string").select(T.clean_answer(F.col("a"), rules)).first()[0]
    assert clean("Sen IDYL and idill, Idil\nSen say idillic ") == "İdil and İdil, İdil\nsay idillic"


def test_content_and_staff(spark):
    content = [
        ('[{"title": " A ", "text": "<p>x</p>", "k": 1, "o": {"z": 2}}, 7, {"title": "B", "body": "<a href=\\"/f.pdf\\">F</a>"}]', "── A ──\nx\n\n── B ──\nF [PDF]", ["/f.pdf"], {"title": " A ", "k": "1", "o": '{"z":2}'}),
        ('[{"title": "A", "text": "x"}]', "x", [], {"title": "A"}),
        ('{"content": "[{\\"text\\": \\"<b>in</b>\\"}]", "e": null}', "in", [], {"e": None}),
        ("[7]", "", [], None), ("[]", "", [], None), ("broken", "", [], None), (None, "", [], None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(content)], "id int, body string")
    for r in parsing.parse_content(df).collect():
        assert (r["text"], r["pdf_links"], r["extra"]) == content[r["id"]][1:]
    staff = json.dumps([{"staff": {"id": 3, "name": " N ", "surName": None, "staffTitle": {"translateStaffCadre": {"tr": {"title": "Dr"}}}, "translateStaff": {"tr": {"position": "p "}}, "email": " m "}}, {"staff": {}}, {"x": 1}, 4])
    rows = spark.createDataFrame([(staff,), ('{"a": 1}',), (None,)], "body string").select(parsing.staff_rows(F.col("body")).alias("s")).collect()
    assert [tuple(x) for x in rows[0]["s"]] == [("3", "N", "Dr", "", "p", "m", "")] and rows[1]["s"] == rows[2]["s"] == []


def test_questions_and_static_chunks(spark):
    faq = [("Cat", [("q1", "a" * 90), ("", "b")]), ("", [("q2", "")])]
    t = "array<struct<title:string,items:array<struct<title:string,body:string>>>>"
    rec = spark.createDataFrame([("f", "L", "u", "faq", None, None, faq), ("s", "L", "u", "staff", None, ["x" * 50, "y" * 50], None), ("t", "L", "u", "text", "  ", None, None), ("n", "L", "u", None, None, None, None)], f"key string, label string, url string, content_kind string, text string, staff_lines array<string>, faq {t}")
    got = rec.select("key", chunking.static_text(*(F.col(c) for c in ("label", "content_kind", "text", "staff_lines", "faq"))).alias("t")).collect()
    assert {r["key"]: r["t"] for r in got} == {"f": f"## Cat\n\n### q1\n\n{'a' * 90}\n\nb\n\n### q2", "s": f"L\n\n{'x' * 50}\n{'y' * 50}", "t": None, "n": None}
    ann = spark.createDataFrame([(5, "T" * 80, "body", "u1", "d", [("p", "pdf", "att"), ("p2", "pdf", chunking.SENTINELS[0])])], "id long, title string, content string, source_url string, updated string, attachments array<struct<url:string,type:string,content:string>>")
    rows = {r["doc_id"]: r for r in chunking.chunk_all(ann, rec, F.lit("now")).collect()}
    assert set(rows) == {"5", "5_att0", "f", "s"} and rows["5_att0"]["source_url"] == "p" and rows["5"]["source_url"] == "u1"
    assert rows["5_att0"]["metadata"] == {"category": "duyuru", "title": "T" * 80, "updated": "d", "ann_id": "5", "type": "pdf_attachment", "att_index": "0", "chunk_index": "0", "total_chunks": "1"}


def pdf(*lines):
    body = zlib.compress("\n".join(f"BT ({x}) Tj ET" for x in lines).encode())
    return b"%PDF-1.4\n1 0 obj <</Length 9>>\nstream\n" + body + b"\nendstream\nendobj"


def test_pdf_scan_and_attachments(spark):
    class Broken:
        def extract(self, data):
            raise OSError("broken")

    files = spark.createDataFrame([("http://a.pdf", bytearray(pdf("one \\(1\\)", "two"))), ("file://b.pdf", bytearray(pdf("x"))), ("http://c.pdf", bytearray(b"<html>c")), ("http://d.pdf", bytearray(b"%PDF nothing"))], "url string, content binary")
    got = {r["url"]: (r["pdf_text"], r["error"]) for r in pages.pdf_scan(files, [Broken(), models.StreamTextExtractor()]).collect()}
    assert got == {"http://a.pdf": ("one (1)\ntwo", None), "file://b.pdf": (None, pages.LOCAL_FILE), "http://c.pdf": ("<html>c", pages.NOT_A_PDF), "http://d.pdf": (None, None)}
    rec = spark.createDataFrame([(1, ["http://a.pdf", "http://z.pdf"]), (2, [])], "id long, pdf_links array<string>")
    rows = {r["id"]: [tuple(a) for a in r["attachments"]] for r in pages.with_pdf_texts(rec, pages.pdf_scan(files, [models.StreamTextExtractor()])).collect()}
    assert rows == {1: [("http://a.pdf", "pdf", "one (1)\ntwo"), ("http://z.pdf", "pdf", pages.UNREADABLE)], 2: []}
    assert spark.range(1).select(pages.pdf_name(F.lit(7), F.lit("A1"), F.lit("http://x/a b.pdf?q"))).first()[0] == "7_A1_a_b.pdf"


def test_fetch_dump_and_files(spark, tmp_path):
    def fetch(u):
        if u == "bad":
            raise ValueError("no")
        return u.upper()

    rows = {r["url"]: (r["body"], r["error"]) for r in pages.fetch_pages(spark.createDataFrame([("a",), ("bad",), ("c",)], "url string"), fetch, 0.01).collect()}
    assert rows == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}
    pages.dump({"announcements": spark.createDataFrame([("ş",)], "t string")}, str(tmp_path / "dump"))
    assert "ş" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "dump/announcements").glob("*.json"))
    (tmp_path / "x.pdf").write_bytes(pdf("k"))
    assert pages.binary_files(spark, str(tmp_path)).count() == 1
    assert spark.range(1).select(pages.search_excerpt(F.repeat(F.lit("é"), 3000)), pages.search_excerpt(F.lit(None).cast("string"))).first()[:] == ("é" * 2000, "")


def test_pages_of_a_pdf_are_rows_of_an_array(spark):
    class Paged:
        def extract(self, data):
            return [" first ", None, "", "third"]

    class Empty:
        def extract(self, data):
            return ["", " "]

    files = spark.createDataFrame([("http://a.pdf", bytearray(b"%PDF-1.4"))], "url string, content binary")
    row = pages.pdf_scan(files, [Empty(), Paged()]).first()
    assert row["pdf_pages"] == [" first ", "", "", "third"] and row["pdf_text"] == "first\nthird"
    raw = rb"stream" + b"\n" + rb"BT (a\050b\)\n) Tj <C3D6> Tj [(x) -20 <FEFF011F>] TJ ET" + b"\nendstream"
    assert models.StreamTextExtractor().extract(raw) == ["a(b)\nÃÖx\u011f\n"]


def test_models(spark):
    class Broken:
        def score(self, pairs):
            raise RuntimeError

    hits = spark.createDataFrame([(1, i, "exam date", f"the exam {'date' if i == 4 else ''}") for i in range(1, 6)], "query_id int, rank int, q string, t string")
    best = lambda m: [r["rank"] for r in retrieval.rerank(hits, models.rerank_udf(m)("q", "t")).orderBy("rerank").collect()]
    assert best(models.OverlapReranker()) == [4, 1, 2] and best(Broken()) == [1, 2, 3]
    p = spark.createDataFrame([("[1] One two. The exam is in May.", "when is the exam")], "c string, q string").select(models.complete_udf(models.ExtractiveModel())(ask.prompt(F.col("c"), F.col("q"))))
    assert p.first()[0] == "The exam is in May."
    w = spark.createDataFrame([("b a B c",), ("",), (None,)], "t string").select(models.sparse_weights(F.col("t")).alias("w")).select("w", models.sparse_parts(F.col("w")).alias("p")).collect()
    assert w[0]["w"] == {"a": 1, "b": 2, "c": 1} and w[1]["w"] == {} and w[2]["w"] is None and tuple(w[0]["p"]) == (["a", "b", "c"], [1.0, 2.0, 1.0])
    rows = spark.createDataFrame([("a a b",), (None,)], "text string").mapInPandas(models.encode_batch(models.HashEmbedder(8), 1), "text string, dense array<float>, sparse map<string,int>").collect()
    assert rows[0]["sparse"] == {"a": 2, "b": 1} and abs(np.linalg.norm(rows[0]["dense"]) - 1) < 1e-6 and rows[1]["sparse"] == {}


def test_splitter_for_sql(spark):
    chunking.register_splitter(spark)
    assert [len(r["text"]) for r in spark.sql("SELECT * FROM split_text(repeat('a', 1500)) ORDER BY chunk_index").collect()] == [1000, 650]


def test_targets(spark):
    t = catalog.catalogue(spark, [{"key": k, "url": "u", "crawl_type": "api_json", "frequency": f} for k, f in (("a", "daily"), ("b", "weekly"), ("c", "once"))])
    assert catalog.mode_targets(t, "full").count() == 3 and catalog.mode_targets(t, "daily").first()["key"] == "a"
    assert catalog.selected(t, spark.createDataFrame([("c",), ("c",), ("z",)], "key string")).count() == 1
    with pytest.raises(ValueError):
        catalog.mode_targets(t, "hourly")


def _asked(spark):
    q = [(1, "what is the exam date", None, [1.0, 0.0]), (2, "hello", "s2", [0.0, 1.0]), (3, "bu nedir peki acaba", "s3", [1.0, 0.0]), (4, "", None, [1.0, 0.0]), (5, "what of the library", None, [0.6, 0.8])]
    entries = spark.createDataFrame([(9, [1.0, 0.001], "cached")], "entry_id long, vec array<double>, answer string")
    return spark.createDataFrame(q, "question_id long, question string, session_id string, vec array<double>"), entries


@pytest.mark.parametrize("gated", [False, True])
def test_ask_batch(spark, gated):
    asked, entries = _asked(spark)
    retrieve = lambda q: q.withColumn("context", F.when(F.col("question_id") == 5, "the library is open"))
    out = ask.ask_batch(asked, entries, retrieve, lambda q: q.withColumn("answer", F.col("context")), F.lit("2024-01-01").cast("timestamp"), gated=gated)
    rows = {r["question_id"]: r for r in out.collect()}
    assert {i: r["route"] for i, r in rows.items()} == {1: "cache", 2: "direct", 3: "rag" if gated else "cache", 5: "rag"}
    assert rows[1]["answer"] == "cached" and len(rows[1]["session_id"]) == 36 and rows[2]["session_id"] == "s2"
    puts = ask.cache_puts(out, asked).collect()
    assert {r["question_id"] for r in puts} == {5} and puts[0]["answer"] == "the library is open"
    assert ask.new_turns(out).count() == 8
    assert ask.response_time(out, F.lit("2024-01-01 00:00:01.5").cast("timestamp")).first()["response_time"] == 1.5


def test_sessions_and_stats(spark):
    turns = spark.createDataFrame([("a", i, "user", f"m{i}") for i in range(25)] + [("b", 0, "user", "x")], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: r for r in ask.read_session(turns, spark.createDataFrame([("a",), ("z",)], "conv_id string")).collect()}
    assert got["a"]["message_count"] == 20 and got["z"]["history"] == [] and got["z"]["message_count"] == 0
    assert ask.delete_sessions(turns, turns.filter("conv_id = 'a'")).count() == 1
    assert tuple(ask.stats(turns, None).first()) == ("ok", 26, None, None, "no table of entries")
    lines = metrics.exposition(metrics.counter(turns, ["conv_id"]), "n", "counter", ["conv_id"]).orderBy("part", "line").collect()
    assert [r["line"] for r in lines] == ["# TYPE n counter", 'n{conv_id="a"} 25', 'n{conv_id="b"} 1']


def test_many_queries_pass_in_waves(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)] + [(90, None), (91, [0.0] * 4)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    want = sorted(map(tuple, retrieval.top_k_batch(q, v, 3).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, retrieval.top_k_batch(q, v, 3).collect())) == want and len(want) == 60
    own = retrieval.top_k_batch(q, v, 1, exclude_own=True).collect()
    assert all(r["query_id"] != r["vec_id"] for r in own)


def test_salted_tokens_equal_the_broadcast(spark, monkeypatch):
    d = spark.createDataFrame([(i, "the " + " ".join(f"w{j}" for j in range(i % 5))) for i in range(40)], "doc_id long, text string")
    q = retrieval.tokens(d.filter("doc_id < 6").withColumnRenamed("doc_id", "query_id"), "query_id", "text")
    want = sorted(map(tuple, retrieval.term_overlap(q, retrieval.tokens(d, "doc_id", "text"), 4).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, retrieval.term_overlap(q, retrieval.tokens(d, "doc_id", "text"), 4).collect())) == want


def test_ensure_and_probe(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"), 4)
    assert s.ensure("id long, v array<float>", ["id"]).count() == 0
    s.upsert(spark.createDataFrame([(1, [1.0])], "id long, v array<float>"), ["id"], "v")
    assert s.ensure("id long, v array<float>", ["id"]).count() == 1
    hits = memory.cache_lookup(spark.createDataFrame([(1, [1.0, 0.0])], "probe_id long, vec array<double>"), spark.createDataFrame([(5, [1.0, 0.0], ""), (7, [1.0, 0.0], "y"), (6, [1.0, 0.0], "x")], "entry_id long, vec array<double>, answer string"))
    assert [tuple(r) for r in hits.collect()] == [(1, 6, 1.0, "x")]


def test_session_stream_and_first_puts(spark, tmp_path):
    from lodeworks.streaming import sessions

    key = "spark.sql.streaming.stateStore.providerClass"
    schema = "session_id string, ts timestamp, role string, text string"
    base = "2024-01-01 {}:00"
    batches = [
        [("a", "10:00", "user", "q1"), ("a", "10:01", "assistant", "r1"), ("b", "10:00", "user", "x")],
        [("a", "11:00", "user", "q2")],
        [("c", "23:00", "user", "late")],
        [("c", "23:01", "user", "later")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(s, base.format(t), r, x) for s, t, r, x in rows], "session_id string, ts string, role string, text string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    before = spark.conf.get(key, None)
    spark.conf.set(key, sessions.ROCKSDB)
    try:
        (tmp_path / "src").mkdir()
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        for i in range(len(batches)):
            f = next((tmp_path / f"in/{i}").glob("*.parquet"))
            f.rename(tmp_path / "src" / f"{i}.parquet")
            q = sessions.session_stream(src, 7200, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    rows = [(r["session_id"], [m["text"] for m in r["history"]], r["message_count"], r["expired"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert ("a", ["q1", "r1"], 2, False) in rows and ("a", ["r1", "q2"], 2, False) in rows
    assert ("a", ["r1", "q2"], 2, True) in rows and ("b", ["x"], 1, True) in rows
    assert ("c", ["late", "later"], 2, False) in rows and not any(r[0] == "c" and r[3] for r in rows)

    puts = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:05:00", 2)], "key string, ts string, v int").coalesce(1)
    puts.write.parquet(str(tmp_path / "puts"))
    src = spark.readStream.schema("key string, ts string, v int").parquet(str(tmp_path / "puts"))
    q = sessions.first_puts(src, "key").writeStream.format("parquet").option("path", str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "kept")).count() == 1


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "c"), 8)
    rows = lambda ids, v: spark.createDataFrame([(i, v, {"k": str(v)}) for i in ids], "id long, v int, m map<string,string>")
    s.upsert(rows(range(50), 1), ["id"], "v")
    before = s._manifest()[1]["buckets"]
    s.upsert(rows([3], 2), ["id"], "v")
    after = s._manifest()[1]["buckets"]
    assert sum(before[b] != after[b] for b in after) == 1 and len(after) == 8
    assert {r["id"]: (r["v"], r["m"]["k"]) for r in s.read().collect()} == {i: (2, "2") if i == 3 else (1, "1") for i in range(50)}
    s.upsert(rows([3], 1), ["id"], "v")  # an older version changes nothing
    s.upsert(spark.createDataFrame([(60, 1, "new")], "id long, v int, extra string"), ["id"], "v")
    got = {r["id"]: r for r in s.read().collect()}
    assert got[3]["v"] == 2 and got[60]["extra"] == "new" and got[1]["extra"] is None and len(got) == 51
    s.delete(F.col("id") < 40)
    s.vacuum(1)
    assert sorted(r["id"] for r in s.read().collect()) == [*range(40, 50), 60] and len(s._numbers()) == 1
    number, manifest = s._manifest()
    with pytest.raises(RuntimeError):
        s._publish(number, manifest)
    with pytest.raises(ValueError):
        s.upsert(rows([1], 1), ["v"], "v")


def test_questions_become_chunks_and_a_target_without_any_is_an_error(spark):
    from lodeworks.operators import chunking

    menu = spark.createDataFrame([(1, 0, None), (5, 1, '{"tr": "Kayıt"}'), (6, 2, '{"tr": "Harç"}')], "cid long, position int, translate string")
    body = '[{"id": 1, "title": "Ne zaman?", "text": "<p>Eylülde, ders başlamadan önceki hafta içinde, öğrenci işleri biriminde ve yalnızca hafta içi günlerde. <a href=\'/f.pdf\'>Form</a></p>"}, {"id": 2, "title": "Nerede?", "text": "<p>Binada.</p>"}]'
    pages_ = parsing.question_pages(menu, spark.createDataFrame([(1, body), (5, body)], "cid long, body string"), 1, "https://e.com").withColumn("key", F.lit("faq"))
    targets = spark.createDataFrame([("faq", "L", "u", "api_sss"), ("none", "L", "u", "api_sss"), ("page", "L", "u", "html_js")], "key string, label string, url string, crawl_type string")
    records = parsing.static_records(targets, spark.createDataFrame([], "key string, body string"), "https://e.com", parsing.questions_of(pages_, "key"))
    rows = {r["key"]: r for r in records.collect()}
    assert rows["faq"]["content_kind"] == "faq" and rows["faq"]["extra"] == {"categories": "2", "total_questions": "4"} and rows["faq"]["error"] is None
    assert rows["faq"]["pdf_links"] == ["https://e.com/f.pdf"]
    assert rows["none"]["error"] == parsing.NO_QUESTIONS and rows["page"]["error"] == parsing.NO_PARSER and rows["none"]["content_kind"] is None
    chunk = chunking.static_chunks(records).collect()
    assert {c["doc_id"] for c in chunk} == {"faq"} and len(chunk) == 2 and "### Ne zaman?  \nEylülde, ders" in chunk[0]["text"] and all(c["metadata"]["category"] == "statik" for c in chunk)
