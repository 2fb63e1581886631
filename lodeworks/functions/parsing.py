"""Parsers of content, staff and question records that come as JSON text. All but the HTML of a record stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.html import html_list_udf, html_udf
from lodeworks.functions.text import json_body, json_field_pick, staff_line, strip

#: Fields of a content record that hold its text; all others are passed on as extras.
TEXT_FIELDS = ["text", "content", "body"]
# Header of a content block, title of the parent page's questions.
BLOCK_HEADER = ("── ", " ──\n")
GENERAL_QUESTIONS = "Sıkça Sorulan Sorular (Genel)"


def json_kind(body: Column) -> Column:
    """list, dict, str or other for JSON text; null where it doesn't parse."""
    # an array of one and transform: the text is parsed once, however often its kind is looked at
    found = F.transform(F.transform(F.array(F.try_parse_json(body)), F.schema_of_variant), _kind)
    return F.get(found, F.lit(0))


def _kind(schema: Column) -> Column:
    return F.when(schema.isNull(), None).when(schema.startswith("ARRAY"), "list").when(schema.startswith("OBJECT"), "dict").when(schema == "STRING", "str").otherwise("other")


def json_scan(pages: DataFrame, page: str = "html", cleaned: str = "cleaned") -> DataFrame:
    """pages with `body`: the page's JSON text, else that of its cleaned form, else null."""
    some = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return pages.withColumn("body", F.coalesce(some(json_body(F.col(page))), some(F.col(cleaned))))


def items_of(body: Column, dicts: bool = True) -> Column:
    """JSON text of each item of a list; a dict is its only item (unless dicts is false); else none. Items that are no objects stay, as their text."""
    none = F.array().cast("array<string>")

    def items(b):
        each = F.coalesce(F.transform(F.from_json(b, "array<variant>"), lambda v: F.to_json(v)), none)
        return F.get(F.transform(F.array(json_kind(b)), lambda kind: F.when(kind == "list", each).when((kind == "dict") & F.lit(dicts), F.array(b)).otherwise(none)), F.lit(0))

    return F.get(F.transform(F.array(body), items), F.lit(0))


def _is_object(item: Column) -> Column:
    return F.coalesce(F.ltrim(item).startswith("{"), F.lit(False))


def _field(item: Column, path: str) -> Column:
    return strip(F.coalesce(F.get_json_object(item, path), F.lit("")))


def extras(item: Column) -> Column:
    """All keys of a JSON object but those of its text, as map<string,string>."""
    return F.map_filter(F.from_json(item, "map<string,string>"), lambda k, _: ~k.isin(TEXT_FIELDS))


def parse_content(records: DataFrame, body: str = "body", base: str = "") -> DataFrame:
    """records with text, pdf_links and extra of their content: blocks of a list under their titles, or one text.

    Titles head blocks only where the list has several items; items that are no objects are skipped.
    """
    df = records.withColumn("_items", items_of(F.col(body))).withColumn("_list", json_kind(F.col(body)) == "list")
    df = df.withColumn("_clean", html_list_udf(base)(F.transform("_items", lambda x: F.when(_is_object(x), json_field_pick(x)).otherwise(F.lit("")))))
    many = F.size("_items") > 1
    title = lambda x: F.when(_is_object(x), _field(x, "$.title")).otherwise(F.lit(""))
    head = lambda t: F.when((F.length(t) > 0) & many & F.col("_list"), F.concat(F.lit(BLOCK_HEADER[0]), t, F.lit(BLOCK_HEADER[1]))).otherwise(F.lit(""))
    blocks = F.filter(F.zip_with("_items", "_clean", lambda x, c: F.when(F.length(c["text"]) > 0, F.concat(head(title(x)), c["text"]))), lambda b: b.isNotNull())
    first = F.get("_items", F.lit(0))
    return df.select(
        *records.columns,
        F.array_join(blocks, "\n\n").alias("text"),
        F.array_distinct(F.flatten(F.transform("_clean", lambda c: c["pdf_links"]))).alias("pdf_links"),
        F.when(_is_object(first), extras(first)).alias("extra"),
    )


def staff_rows(body: Column) -> Column:
    """array<struct> of the staff of a list: trimmed fields, empty where a path leads nowhere."""
    name = lambda s: strip(F.concat_ws(" ", _field(s, "$.name"), _field(s, "$.surName")))
    duty = lambda s: F.coalesce(F.nullif(F.get_json_object(s, "$.translateStaff.tr.description"), F.lit("")), F.get_json_object(s, "$.translateStaff.tr.position"), F.lit(""))
    row = lambda s: F.struct(
        F.coalesce(F.get_json_object(s, "$.id"), F.lit("")).alias("id"),
        name(s).alias("name"),
        _field(s, "$.staffTitle.translateStaffCadre.tr.title").alias("title"),
        _field(s, "$.staffGroup.translateStaffGroup.tr.title").alias("unit"),
        strip(duty(s)).alias("duty"),
        _field(s, "$.email").alias("email"),
        _field(s, "$.phone").alias("phone"),
    )
    staff = F.filter(F.transform(F.filter(items_of(body, dicts=False), _is_object), lambda x: F.get_json_object(x, "$.staff")), lambda s: _is_object(s) & (F.regexp_replace(s, r"\s", "") != "{}"))
    return F.transform(staff, row)


def staff_lines(staff: Column) -> Column:
    return F.transform(staff, lambda s: staff_line(s["name"], s["title"], s["unit"], s["duty"], s["email"], s["phone"]))


def question_items(body: Column) -> Column:
    """array<struct<id, title, html>> of the objects of a list."""
    return F.transform(F.filter(items_of(body), _is_object), lambda x: F.struct(F.coalesce(F.get_json_object(x, "$.id"), F.lit("")).alias("id"), _field(x, "$.title").alias("title"), F.coalesce(F.get_json_object(x, "$.text"), F.lit("")).alias("html")))


def question_pages(menu: DataFrame, contents: DataFrame, parent: int, base: str = "") -> DataFrame:
    """Categories of questions: menu (cid, translate: JSON text) joined to contents (cid, body) on cid, the parent first.

    Returns position (the parent's is -1), cid, title, items array<struct<id, title, body, pdf_links>>. Categories
    without content drop out; a title comes from the nested JSON's `tr`, else it is the id.
    """
    told = F.coalesce(F.get_json_object("translate", "$.tr"), F.col("cid").cast("string"))
    rows = menu.filter(F.col("cid").isNotNull() & (F.col("cid") != parent)).select("cid", F.col("position").cast("int").alias("position"), told.alias("title"))
    head = contents.filter(F.col("cid") == parent).select("cid", F.lit(-1).alias("position"), F.lit(GENERAL_QUESTIONS).alias("title"), "body")
    found = head.unionByName(rows.join(contents, "cid")).withColumn("_q", question_items(F.col("body"))).filter(F.col("body").isNotNull())
    found = found.withColumn("_c", html_list_udf(base)(F.transform("_q", lambda q: q["html"])))
    items = F.zip_with("_q", "_c", lambda q, c: F.struct(q["id"].alias("id"), q["title"].alias("title"), c["text"].alias("body"), c["pdf_links"].alias("pdf_links")))
    return found.select("position", "cid", "title", items.alias("items"))


def question_counts(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("categories"), F.coalesce(F.sum(F.size("items")), F.lit(0)).cast("long").alias("total_questions"))


#: Categories of questions of a static record, in order.
FAQ = "array<struct<title:string,items:array<struct<title:string,body:string>>>>"


def questions_of(pages: DataFrame, key: str) -> DataFrame:
    """question_pages, with a column that names their target -> key, faq in the order of positions, categories, total_questions, pdf_links."""
    items = F.transform("items", lambda q: F.struct(q["title"].alias("title"), q["body"].alias("body")))
    links = F.flatten(F.transform("items", lambda q: q["pdf_links"]))
    part = F.struct("position", "cid", "title", items.alias("items"), links.alias("links"))
    told = pages.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return told.select(
        "key",
        F.transform("_p", lambda p: F.struct(p["title"].alias("title"), p["items"].alias("items"))).cast(FAQ).alias("faq"),
        F.size("_p").alias("categories"),
        F.aggregate("_p", F.lit(0), lambda n, p: n + F.size(p["items"])).alias("total_questions"),
        F.array_distinct(F.flatten(F.transform("_p", lambda p: p["links"]))).alias("faq_links"),
    )


def static_records(targets: DataFrame, bodies: DataFrame, base: str = "", questions: DataFrame | None = None) -> DataFrame:
    """Targets with their parsed content by kind; bodies: key, body (JSON text, null on failure); questions: questions_of(...)
    for the targets of kind api_sss. A failure fills `error`, also for kinds that no parser is for."""
    df = targets.select("key", "label", "url", "crawl_type").join(bodies.select("key", "body"), "key", "left")
    df = parse_content(df, "body", base)
    if questions is not None:
        df = df.join(questions, "key", "left")
    else:
        df = df.withColumns({"faq": F.lit(None).cast(FAQ), "categories": F.lit(0), "total_questions": F.lit(0), "faq_links": F.lit(None).cast("array<string>")})
    kind = F.col("crawl_type")
    staff, plain, asked = kind == "api_staff", kind == "api_json", kind == "api_sss"
    some, told = F.col("body").isNotNull(), F.coalesce(F.size("faq") > 0, F.lit(False))
    people = staff_rows(F.col("body"))
    counts = F.create_map(F.lit("categories"), F.col("categories").cast("string"), F.lit("total_questions"), F.col("total_questions").cast("string"))
    none = F.array().cast("array<string>")
    return df.select(
        "key", "label", "url",
        F.when(staff & some, "staff").when(plain & some, "text").when(asked & told, "faq").alias("content_kind"),
        F.when(plain & some, F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(EMPTY_CONTENT))).alias("text"),
        F.when(staff, staff_lines(people)).alias("staff_lines"),
        F.when(asked & told, F.col("faq")).alias("faq"),
        F.when(staff, none).when(asked, F.coalesce("faq_links", none)).otherwise(F.col("pdf_links")).alias("pdf_links"),
        F.when(staff, F.create_map(F.lit("count"), F.size(people).cast("string"))).when(asked & told, counts).when(plain, F.col("extra")).alias("extra"),
        F.when(asked & ~told, NO_QUESTIONS).when((staff | plain) & ~some, NO_DATA).when(~(staff | plain | asked), NO_PARSER).alias("error"),
    )


# Text of a record whose content is empty, errors of one without data and of one without questions.
EMPTY_CONTENT, NO_DATA, NO_QUESTIONS = "[İçerik boş]", "Veri çekilemedi", "SSS verisi çekilemedi"
#: Error of a kind that is only ever crawled as pages.
NO_PARSER = "kind without a parser"


def announcements(listing: DataFrame, details: DataFrame, url_template: str, base: str = "") -> DataFrame:
    """Listing items (id, title, updated, url) with the detail record found by id (id, body): one join in place of a request for each.

    Attachments are the detail's PDF links, local files excluded; their texts come with pages.with_pdf_texts.
    """
    from lodeworks.functions.text import fill_template, is_local_file

    df = listing.join(details.select("id", "body"), "id", "left")
    pick = F.when(json_kind(F.col("body")) == "dict", F.coalesce(F.nullif(F.get_json_object("body", "$.text"), F.lit("")), F.get_json_object("body", "$.content")))
    df = df.withColumn("_h", html_udf(base)(F.coalesce(pick, F.lit(""))))
    own = F.nullif(strip(F.coalesce("url", F.lit(""))), F.lit(""))
    return df.select(
        "id", "title", "updated",
        F.coalesce(own, fill_template(url_template, id=F.col("id"))).alias("source_url"),
        F.when(F.col("body").isNull(), NO_DETAIL).otherwise(F.nullif(F.col("_h.text"), F.lit(""))).alias("content"),
        F.filter(F.col("_h.pdf_links"), lambda x: ~is_local_file(x)).alias("pdf_links"),
    )


# Fixed value: content of an announcement whose detail is missing.
NO_DETAIL = "[Detay içeriği alınamadı]"
