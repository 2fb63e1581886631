"""Heading-aware, overlapping chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import point_id, strip

SIZE, OVERLAP, LEAST = 1000, 150, 80
# Separators from coarse to fine.
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", ", ", " ", ""]
_HEADER = re.compile(r"^(#{1,3})\s+(.*)$")


def split_headers(text: str) -> list[str]:
    """Sections by headers of levels 1 to 3; a header without body goes with what follows it."""
    sections, lines, fenced, body = [], [], False, False
    for raw in text.split("\n"):
        line = raw.strip()
        if line.startswith("```") or line.startswith("~~~"):
            fenced = not fenced
        if not fenced and _HEADER.match(line):
            if body:
                sections.append(lines)
                lines, body = [], False
        elif line:
            body = True
        if line:
            lines.append(line)
    return ["  \n".join(x) for x in [*sections, lines] if x]


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most `size`, cut at the coarsest separator that occurs, each starting with up to `overlap` of the one before."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        first, *more = text.split(sep)
        pieces = [p for p in [first, *(sep + m for m in more)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit():
        if chunk := "".join(held).strip():
            out.append(chunk)

    for p in pieces:
        if len(p) > size:
            if held:
                emit()
                held.clear()
                total = 0
            out += split_recursive(p, size, overlap, rest) if rest else [p]
            continue
        if total + len(p) > size and held:
            emit()
            drop = 0
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(held[drop])
                drop += 1
            del held[:drop]
        held.append(p)
        total += len(p)
    if held:
        emit()
    return out


def chunk_text(text: str | None) -> list[str]:
    if not text or not text.strip():
        return []
    sections = split_headers(text) if "\n#" in text or text.startswith("#") else [text]
    out = []
    for s in sections:
        out += [s] if len(s) <= SIZE else split_recursive(s)
    return [y for x in out if len(y := x.strip()) >= LEAST]


def chunks_of(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(t) for t in texts])

    return split(text)


def chunk_table(docs: DataFrame, text: Column, source_key: Column, doc_id: Column, keep: list[str] = ()) -> DataFrame:
    """One row for each chunk: source_key, doc_id, chunk_index, total_chunks, text, point_id, and the columns to keep."""
    df = docs.select(source_key.alias("source_key"), doc_id.cast("string").alias("doc_id"), *keep, chunks_of(text).alias("_chunks"))
    df = df.select("source_key", "doc_id", *keep, F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "text"))
    return df.withColumn("point_id", point_id(F.col("source_key"), F.col("doc_id"), F.col("chunk_index")))


def short_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts that are one chunk as they stand, without a splitter."""
    t = F.col(text)
    return docs.filter((F.length(t) <= SIZE) & (F.length(strip(t)) >= LEAST) & ~t.startswith("#") & ~t.contains("\n#")).withColumn(text, strip(t))


#: Attachment texts that stand for a file that couldn't be read, and the source key of announcements.
SENTINELS = ["[PDF Okunamadı]", "[İçerik alınamadı]"]
ANNOUNCEMENTS = "duyurular_api"


def usable_attachment(text: Column) -> Column:
    """Attachment texts that are chunked: not null, not empty, and no sentinel."""
    return F.coalesce((F.length(text) > 0) & ~text.isin(SENTINELS), F.lit(False))


def announcement_rows(records: DataFrame) -> DataFrame:
    """Announcements (id, title, content, attachments array<struct<url,type,content>>) to body and attachment texts."""
    body = records.select(F.col("id").cast("string").alias("doc_id"), F.col("id").alias("ann_id"), F.lit(None).cast("int").alias("att_index"), F.concat_ws("\n\n", F.nullif("title", F.lit("")), F.nullif("content", F.lit(""))).alias("text"))
    parts = records.select("id", "title", F.posexplode("attachments").alias("i", "att")).filter(usable_attachment(F.col("att.content")))
    parts = parts.select(F.concat_ws("_att", F.col("id").cast("string"), F.col("i").cast("string")).alias("doc_id"), F.col("id").alias("ann_id"), F.col("i").alias("att_index"), F.concat(F.coalesce("title", F.lit("")), F.lit(" (Ek "), (F.col("i") + 1).cast("string"), F.lit(")\n\n"), F.col("att.content")).alias("text"))
    return body.unionByName(parts)


def _metadata(**columns: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns.values())))


def merged(base: Column, later: Column) -> Column:
    """Two maps as one; a key of both has the later map's value, whatever the session says of such keys."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(later, k)), later)


def announcement_chunks(records: DataFrame) -> DataFrame:
    """Chunks of bodies and attachments; records have source_url and updated beside the columns of announcement_rows."""
    about = records.select(F.col("id").alias("ann_id"), "title", "updated", F.coalesce("source_url", F.concat(F.lit("announcement:"), F.col("id").cast("string"))).alias("_from"), "attachments")
    rows = announcement_rows(records).join(about, "ann_id")
    own = F.coalesce(F.try_element_at("attachments", F.col("att_index") + 1)["url"], F.col("_from"))
    base = _metadata(category=F.lit("duyuru"), title=F.col("title"), updated=F.col("updated"), ann_id=F.col("ann_id"))
    more = F.when(F.col("att_index").isNotNull(), merged(base, _metadata(type=F.lit("pdf_attachment"), att_index=F.col("att_index")))).otherwise(base)
    rows = rows.select("doc_id", "text", F.when(F.col("att_index").isNull(), F.col("_from")).otherwise(own).alias("source_url"), more.alias("metadata"))
    return chunk_table(rows, F.col("text"), F.lit(ANNOUNCEMENTS), F.col("doc_id"), ["source_url", "metadata"])


def static_chunks(records: DataFrame) -> DataFrame:
    """Chunks of static records: key, label, url, content_kind (staff, faq or text), text, staff_lines, faq, pdf_links."""
    t = static_text(F.col("label"), F.col("content_kind"), F.col("text"), F.col("staff_lines"), F.col("faq"))
    rows = records.select("key", F.col("url").alias("source_url"), _metadata(category=F.lit("statik"), label=F.coalesce("label", "key"), key=F.col("key")).alias("metadata"), t.alias("_text"))
    return chunk_table(rows.filter(F.col("_text").isNotNull()), F.col("_text"), F.col("key"), F.col("key"), ["source_url", "metadata"])


def chunk_all(announcements: DataFrame, statics: DataFrame, created_at: Column) -> DataFrame:
    """Chunks of both, with one creation time for the whole run, and chunk_index and total_chunks in the metadata."""
    both = announcement_chunks(announcements).unionByName(static_chunks(statics))
    return both.withColumn("created_at", created_at).withColumn("metadata", merged(F.col("metadata"), _metadata(chunk_index=F.col("chunk_index"), total_chunks=F.col("total_chunks"))))


def payload(chunks: DataFrame) -> Column:
    """The stored payload: base fields, then the metadata, whose values win."""
    base = ("text", "source_url", "source_key", "doc_id", "chunk_index", "created_at")
    return merged(_metadata(**{c: F.col(c) for c in base}), F.col("metadata"))


@F.udtf(returnType="chunk_index int, text string")
class SplitText:
    """Table function for SQL: SELECT * FROM split_text('...'); registered by register_splitter."""

    def eval(self, text: str):
        yield from enumerate(chunk_text(text))


def register_splitter(spark, name: str = "split_text") -> None:
    spark.udtf.register(name, SplitText)


def static_text(label: Column, kind: Column, text: Column, staff_lines: Column, faq: Column) -> Column:
    """Text of a static record by kind: staff lines and plain text under their label, FAQ as headings; null for what has none."""
    some = lambda prefix, x: F.when(F.length(x) > 0, F.concat(F.lit(prefix), x))
    part = lambda c: F.concat(F.array(some("## ", c["title"])), F.flatten(F.transform(c["items"], lambda q: F.array(some("### ", q["title"]), some("", q["body"])))))
    blocks = F.array_compact(F.flatten(F.transform(faq, part)))
    return (
        F.when(kind == "staff", F.concat(label, F.lit("\n\n"), F.array_join(staff_lines, "\n")))
        .when(kind == "faq", F.array_join(blocks, "\n\n"))
        .when((kind == "text") & (F.length(strip(text)) > 0), F.concat(label, F.lit("\n\n"), text))
    )
