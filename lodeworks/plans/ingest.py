"""Registered queries of sources, parsers and chunks. Records are JSON text built from the test tables, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import blocks, parsing
from lodeworks.functions import text as T
from lodeworks.operators import chunking, metrics
from lodeworks.plans.registry import query
from lodeworks.session import table
from lodeworks.sources import catalog, crawl, pages

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _content(spark, sf):
    """Parts as content records: a list of two items for even keys, one object for odd ones."""
    p = table(spark, sf, "part")
    item = lambda title, text: F.struct(title.alias("title"), text.alias("content"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    two = F.to_json(F.array(item(F.col("p_name"), F.col("p_type")), item(F.lit(""), F.concat(F.lit("<b>"), F.col("p_brand"), F.lit("</b>")))))
    one = F.to_json(item(F.col("p_name"), F.col("p_type")))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, two).otherwise(one).alias("body"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '── ' || trim(p_name) || ' ──' || chr(10) || trim(p_type) || chr(10) || chr(10) || trim(p_brand) ELSE trim(p_type) END AS text, p_brand AS brand, p_size::VARCHAR AS size, 3 AS n_extra FROM part")
def content_parse(spark, sf):
    df = parsing.parse_content(_content(spark, sf))
    return df.select("p_partkey", "text", F.col("extra")["brand"].alias("brand"), F.col("extra")["size"].alias("size"), F.size("extra").alias("n_extra"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'dict' WHEN 2 THEN 'str' ELSE NULL END AS kind FROM orders")
def type_predicate(spark, sf):
    """Orders as JSON: a list with one, an object, its status as a string, and an object cut short."""
    o = table(spark, sf, "orders")
    whole = F.to_json(F.struct("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price")))
    status = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
    body = F.element_at(F.array(F.concat(F.lit("["), whole, F.lit("]")), whole, status, F.substring(whole, F.lit(1), F.length(whole) - 1)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", parsing.json_kind(body).alias("kind"))


@query("SELECT c_custkey, trim(c_name) || ' ' || trim(c_mktsegment) AS name, c_mktsegment AS title, '' AS unit, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'p' END AS duty, c_nationkey::VARCHAR AS phone FROM customer")
def staff_projection(spark, sf):
    s = F.struct
    tr = s(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("description"), F.lit("p").alias("position"))
    staff = s(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit(" "), F.col("c_name")).alias("name"),
        F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("surName"),
        s(s(s(F.col("c_mktsegment").alias("title")).alias("tr")).alias("translateStaffCadre")).alias("staffTitle"),
        s(tr.alias("tr")).alias("translateStaff"),
        F.col("c_nationkey").cast("string").alias("phone"),
    )
    body = F.to_json(F.array(s(staff.alias("staff"))))
    # a few MB of rows are one task's file but many seconds of parsing: all cores take part
    people = table(spark, sf, "customer").repartition(2 * spark.sparkContext.defaultParallelism)
    row = people.select("c_custkey", F.explode(parsing.staff_rows(body)).alias("s"))
    return row.select("c_custkey", *(F.col(f"s.{k}").alias(k) for k in ("name", "title", "unit", "duty", "phone")))


def _questions(spark, sf):
    """Nations as a menu, with customers' names as questions; region 0 is the parent page."""
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("cid"), F.col("n_nationkey").alias("position"), F.to_json(F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("tr"))).alias("translate"))
    c = table(spark, sf, "supplier").groupBy((F.col("s_nationkey") + 1).alias("cid")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("<p>"), F.col("s_name"), F.lit("<p>x")).alias("text")))).alias("q"))
    return parsing.question_pages(n, c.select("cid", F.to_json("q").alias("body")), 1)


_CATEGORIES = "SELECT n_nationkey + 1 AS cid, CASE WHEN n_nationkey = 0 THEN 'Sıkça Sorulan Sorular (Genel)' WHEN n_nationkey % 2 = 0 THEN n_name ELSE (n_nationkey + 1)::VARCHAR END AS title, count(*) AS n, min(trim(s_name) || chr(10) || 'x') AS least FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL"


@query(_CATEGORIES)
def question_pages(spark, sf):
    return _questions(spark, sf).select("cid", "title", F.size("items").cast("long").alias("n"), F.array_min(F.transform("items", lambda q: q["body"])).alias("least"))


@query(f"SELECT count(*) AS categories, sum(n)::BIGINT AS total_questions FROM ({_CATEGORIES})")
def question_counts(spark, sf):
    return parsing.question_counts(_questions(spark, sf))


@query("SELECT p_partkey AS id, p_name AS title, 'https://example.com/get?id=' || p_partkey AS source_url, CASE WHEN p_partkey % 5 = 0 THEN '[Detay içeriği alınamadı]' ELSE trim(p_type) END AS content FROM part")
def announcement_details(spark, sf):
    p = table(spark, sf, "part")
    listing = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("updated"), F.lit(None).cast("string").alias("url"))
    details = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.lit("").alias("text"), F.col("p_type").alias("content"))).alias("body"))
    return parsing.announcements(listing, details, "https://example.com/get?id={id}").select("id", "title", "source_url", "content")


@query("SELECT key, kind, CASE WHEN kind = 'text' THEN CASE WHEN r_regionkey = 1 THEN '[İçerik boş]' ELSE r_name END END AS text, CASE WHEN r_regionkey = 4 THEN 'Veri çekilemedi' END AS error, n_staff FROM (SELECT *, 'k' || r_regionkey AS key, CASE r_regionkey WHEN 0 THEN 'staff' WHEN 4 THEN NULL ELSE 'text' END AS kind, CASE WHEN r_regionkey = 0 THEN 1 END AS n_staff FROM region)")
def static_dispatch(spark, sf):
    r = table(spark, sf, "region").withColumn("key", F.concat(F.lit("k"), F.col("r_regionkey").cast("string")))
    targets = r.select("key", F.col("r_name").alias("label"), F.lit("u").alias("url"), F.when(F.col("r_regionkey") == 0, "api_staff").otherwise("api_json").alias("crawl_type"))
    staff = F.to_json(F.array(F.struct(F.struct(F.col("r_name").alias("name")).alias("staff"))))
    text = F.to_json(F.struct(F.when(F.col("r_regionkey") == 1, "").otherwise(F.col("r_name")).alias("body")))
    bodies = r.select("key", F.when(F.col("r_regionkey") == 0, staff).when(F.col("r_regionkey") < 4, text).alias("body"))
    return parsing.static_records(targets, bodies).select("key", F.col("content_kind").alias("kind"), "text", "error", F.size("staff_lines").alias("n_staff"))


_FAQ = """WITH q AS (SELECT s_nationkey AS n, count(*) AS many, string_agg('### ' || trim(s_name) || chr(10) || chr(10) || trim(s_name) || chr(10) || 'x', chr(10) || chr(10) ORDER BY s_suppkey) AS items FROM supplier GROUP BY s_nationkey),
c AS (SELECT n_regionkey, n, many, '## ' || CASE WHEN n = 0 THEN 'Sıkça Sorulan Sorular (Genel)' WHEN n % 2 = 0 THEN n_name ELSE (n + 1)::VARCHAR END || chr(10) || chr(10) || items AS block FROM q JOIN nation ON n_nationkey = n)
SELECT 'k' || n_regionkey AS key, 'faq' AS kind, count(*)::INT AS categories, sum(many)::INT AS total_questions, string_agg(block, chr(10) || chr(10) ORDER BY n) AS text, NULL AS error FROM c WHERE n_regionkey < 3 GROUP BY n_regionkey
UNION ALL SELECT 'k3', NULL, NULL, NULL, NULL, 'kind without a parser' UNION ALL SELECT 'k4', NULL, NULL, NULL, NULL, 'SSS verisi çekilemedi'"""


@query(_FAQ)
def faq_dispatch(spark, sf):
    """Regions as targets of kind api_sss: their nations as categories, suppliers as questions; one has none, one is of a kind without a parser."""
    r = table(spark, sf, "region").select(F.concat(F.lit("k"), F.col("r_regionkey").cast("string")).alias("key"), "r_regionkey")
    targets = r.select("key", F.lit("l").alias("label"), F.lit("u").alias("url"), F.when(F.col("r_regionkey") == 3, "html_static").otherwise("api_sss").alias("crawl_type"))
    nations = table(spark, sf, "nation").filter("n_regionkey <> 4").select((F.col("n_nationkey") + 1).alias("cid"), F.concat(F.lit("k"), F.col("n_regionkey").cast("string")).alias("key"))
    asked = parsing.questions_of(_questions(spark, sf).join(nations, "cid"), "key")
    rec = parsing.static_records(targets, r.select("key", F.lit(None).cast("string").alias("body")), questions=asked)
    text = chunking.static_text(F.col("label"), F.col("content_kind"), F.col("text"), F.col("staff_lines"), F.col("faq"))
    number = lambda k: F.col("extra")[k].cast("int").alias(k)
    return rec.select("key", F.col("content_kind").alias("kind"), number("categories"), number("total_questions"), text.alias("text"), "error")


def _announcements(spark, sf):
    """Parts as announcements, each with three attachments: a usable one, one that couldn't be read, an empty one."""
    att = lambda text: F.struct(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.lit("pdf").alias("type"), text.alias("content"))
    long = F.repeat(F.col("p_name"), 9)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("2024").alias("updated"), F.when(F.col("p_partkey") % 2 == 0, "s").alias("source_url"), long.alias("content"), F.array(att(long), att(F.lit(chunking.SENTINELS[0])), att(F.lit(""))).alias("attachments"))


@query("SELECT p_partkey || '_att0' AS doc_id, p_name || ' (Ek 1)' || chr(10) || chr(10) || repeat(p_name, 9) AS text FROM part")
def usable_attachments(spark, sf):
    return chunking.announcement_rows(_announcements(spark, sf)).filter("att_index IS NOT NULL").select("doc_id", "text")


_CHUNKS = """WITH t AS (
  SELECT p_partkey::VARCHAR AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE 'announcement:' || p_partkey END AS source_url, p_name || chr(10) || chr(10) || repeat(p_name, 9) AS text, '' AS type, p_name AS title FROM part
  UNION ALL SELECT p_partkey || '_att0', 'u' || p_partkey, p_name || ' (Ek 1)' || chr(10) || chr(10) || repeat(p_name, 9), 'pdf_attachment', p_name FROM part)
SELECT doc_id, source_url, trim(text) AS text, type, title FROM t WHERE length(trim(text)) BETWEEN 80 AND 1000"""


@query(_CHUNKS)
def announcement_chunks(spark, sf):
    df = chunking.announcement_chunks(_announcements(spark, sf))
    return df.select("doc_id", "source_url", "text", F.coalesce(F.col("metadata")["type"], F.lit("")).alias("type"), F.col("metadata")["title"].alias("title"))


@query(f"SELECT doc_id, 'duyuru' AS category, 'late' AS text_key, 1 AS total, text FROM ({_CHUNKS}) UNION ALL SELECT 'k' || r_regionkey, 'statik', 'late', 1, r_name || chr(10) || chr(10) || repeat(r_name, 20) FROM region WHERE length(r_name || repeat(r_name, 20)) BETWEEN 80 AND 990")
def payload_flatten(spark, sf):
    """Chunks of announcements and static records with their payload: base fields, then metadata, whose values win."""
    r = table(spark, sf, "region")
    rec = r.select(F.concat(F.lit("k"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("label"), F.lit("u").alias("url"), F.lit("text").alias("content_kind"), F.repeat("r_name", 20).alias("text"), F.array().cast("array<string>").alias("staff_lines"), F.lit(None).cast(parsing.FAQ).alias("faq"))
    df = chunking.chunk_all(_announcements(spark, sf), rec, F.lit("2024-01-01T00:00:00Z"))
    df = df.withColumn("metadata", chunking.merged(F.col("metadata"), F.create_map(F.lit("source_key"), F.lit("late"))))
    p = chunking.payload(df)
    return df.select("doc_id", p["category"].alias("category"), p["source_key"].alias("text_key"), p["total_chunks"].cast("int").alias("total"), p["text"].alias("text"))


@query(blocks.SQL)
def pruned_pages(spark, sf):
    """Pages without their boilerplate: the blocks that density, links, tag and neighbours let stay."""
    return blocks.pruned_text(table(spark, sf, "pages"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'https://example.com/' || split_part(url, '/', 4) AS src, 'https://example.com' || unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages),
c AS (SELECT min(src) AS url, 0 AS depth FROM e UNION SELECT dst, depth + 1 FROM c JOIN e ON src = url WHERE depth < 3)
SELECT url, min(depth) AS depth FROM c GROUP BY url""")
def crawl_depths(spark, sf):
    """A crawl of three rounds. A page answers at the address of its section, the first part of its path, so an address has many; links lead to sections too."""
    site = table(spark, sf, "pages").select("html", F.concat(F.lit("https://example.com/"), F.split_part("url", F.lit("/"), F.lit(4))).alias("url"))
    linked = site.filter(F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))) > 0)
    seeds = linked.agg(F.min("url").alias("url"))
    return crawl.crawl(seeds, lambda asked: site.join(asked, "url"), 3)


@query("SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def never_seen(spark, sf):
    p = table(spark, sf, "pages")
    return pages.never_seen(p, p.filter("page_id % 2 = 0"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def except_keys(spark, sf):
    c = table(spark, sf, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("k"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).subtract(c)


_TARGETS = "SELECT 'k' || s_suppkey AS key, ['daily', 'weekly', 'monthly'][s_suppkey % 3 + 1] AS frequency FROM supplier"


def _targets(spark, sf):
    f = F.element_at(F.array(*map(F.lit, catalog.FREQUENCIES[:3])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key"), f.alias("frequency"))


@query(f"SELECT key, frequency FROM ({_TARGETS}) WHERE frequency = 'weekly'")
def mode_targets(spark, sf):
    return catalog.mode_targets(_targets(spark, sf), "weekly")


@query(f"SELECT key, frequency FROM ({_TARGETS}) WHERE key IN (SELECT 'k' || n_nationkey FROM nation)")
def key_set_targets(spark, sf):
    return catalog.selected(_targets(spark, sf), table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key")))


@query("SELECT page_id, CASE WHEN starts_with(u, '/') THEN 'https://example.com' || u ELSE u END AS href, contains(lower(u), '.pdf') AS pdf, starts_with(u, 'file://') AS local, 'https://example.com/list?page=' || page_id || '&id=' || page_id AS listed FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/a/b.PDF?x' ELSE 'file://' || url END AS u FROM pages)")
def link_rules(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "/a/b.PDF?x").otherwise(F.concat(F.lit("file://"), F.col("url")))
    listed = T.fill_template("https://example.com/list?page={page}&id={id}", page=F.col("page_id"), id=F.col("page_id"))
    return table(spark, sf, "pages").select("page_id", T.absolute_url(u, "https://example.com").alias("href"), T.is_pdf_link(u).alias("pdf"), T.is_local_file(u).alias("local"), listed.alias("listed"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 2 = 0 THEN '{\"a\":\"<&' || page_id || '\"}' ELSE '[1]' END AS body FROM pages")
def json_scan(spark, sf):
    pre = F.concat(F.lit('x<pre id="p">{"a":"&lt;&amp;'), F.col("page_id").cast("string"), F.lit('"}</pre>y'))
    p = table(spark, sf, "pages").select("page_id", F.when((F.col("page_id") % 2 == 0) & (F.col("page_id") % 5 > 0), pre).otherwise("<p>no json").alias("html"), F.when(F.col("page_id") % 5 > 0, "[1]").otherwise("{broken").alias("cleaned"))
    return parsing.json_scan(p).select("page_id", "body")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, round(epoch_us(ts) % 7000000 / 1e6, 3) AS took FROM events")
def times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    begun = F.timestamp_micros(F.unix_micros(ts) - F.unix_micros(ts) % 7000000)
    return table(spark, sf, "events").select("event_id", T.iso_utc(ts).alias("at"), T.elapsed(begun, ts).alias("took"))


@query("SELECT part, line FROM (SELECT 0 AS part, '# TYPE events_total counter' AS line UNION ALL SELECT 1, 'events_total{event_type=\"' || event_type || '\"} ' || count(*) FROM events GROUP BY event_type)")
def metric_exposition(spark, sf):
    return metrics.exposition(metrics.counter(table(spark, sf, "events"), ["event_type"]), "events_total", "counter", ["event_type"])


@query("SELECT n_name AS nation, r_name AS region, 1 AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def info_constants(spark, sf):
    """An info metric: a series for each nation, whose labels are all that it says."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return metrics.info_series(n, nation="n_name", region="r_name")


@query(r"SELECT doc_id, w AS word, count(*)::INT AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}0-9]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL")
def sparse_vectors(spark, sf):
    from lodeworks.functions.models import sparse_weights

    return table(spark, sf, "documents").select("doc_id", F.explode(sparse_weights(F.col("text"))).alias("word", "n"))
