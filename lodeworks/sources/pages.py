"""Pages and files: PDF scans, pruned pages, crawl dumps, visited sets, and a source that fetches with a delay."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.html import page_udf
from lodeworks.functions.models import HtmlExtractor, LibraryExtractor, PdfExtractor, StreamTextExtractor, pdf_pages_udf
from lodeworks.functions.text import is_local_file, safe_filename, strip

# Errors of a PDF scan, the stand-in for a text that couldn't be read.
LOCAL_FILE, NOT_A_PDF, UNREADABLE = "Yerel dosya, atlandı", "PDF değil, HTML yanıt", "[PDF Okunamadı]"
#: Seconds between requests, characters of a searched page.
REQUEST_DELAY, SEARCH_CHARS = 0.8, 2000


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias("url"), "content")


def pdf_scan(files: DataFrame, extractors: list[PdfExtractor] | None = None) -> DataFrame:
    """files: url, content (bytes). Adds pdf_pages (the text of each page), pdf_text (those that have any, a line end between) and error: local files are skipped, and an answer that is no PDF is kept as text with an error.

    A broken file gives no text; it never fails the batch.
    """
    head = F.ltrim(F.decode(F.substring("content", 1, 64), "ISO-8859-1"))
    is_pdf = head.startswith("%PDF")
    found = pdf_pages_udf(extractors or [LibraryExtractor(), StreamTextExtractor()])(F.when(is_pdf & ~is_local_file(F.col("url")), F.col("content")))
    text = F.array_join(F.filter(F.transform("pdf_pages", strip), lambda p: F.length(p) > 0), "\n")
    plain = F.when(~is_pdf, F.try_validate_utf8(F.col("content").cast("string")))
    return files.withColumn("pdf_pages", found).withColumn("pdf_text", F.when(~is_local_file(F.col("url")), F.coalesce(text, plain))).withColumn("error", F.when(is_local_file(F.col("url")), LOCAL_FILE).when(~is_pdf, NOT_A_PDF))


def pdf_name(record: Column, label: Column, url: Column) -> Column:
    return F.concat_ws("_", record.cast("string"), label, safe_filename(url))


def with_pdf_texts(records: DataFrame, scanned: DataFrame) -> DataFrame:
    """announcements with attachments array<struct<url, type, content>>: each link's text by a join on its url, a sentinel where there is none."""
    links = records.select("id", F.posexplode("pdf_links").alias("i", "url"))
    found = links.join(scanned.select("url", "pdf_text").dropDuplicates(["url"]), "url", "left")
    part = F.struct("i", F.struct("url", F.lit("pdf").alias("type"), F.coalesce(F.nullif("pdf_text", F.lit("")), F.lit(UNREADABLE)).alias("content")).alias("a"))
    each = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["a"]).alias("attachments"))
    none = F.array().cast("array<struct<url:string,type:string,content:string>>")
    return records.join(each, "id", "left").withColumn("attachments", F.coalesce("attachments", none))


def scan_pages(pages: DataFrame, html: str = "html", base: str = "", extractor: HtmlExtractor | None = None) -> DataFrame:
    """pages with text (pruned) and pdf_links, by an extractor of one's own or the standard one."""
    return pages.withColumn("_p", page_udf(base, extractor)(html)).select(*pages.columns, "_p.text", "_p.pdf_links")


def never_seen(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct urls that aren't in the visited set: by anti join."""
    return urls.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def search_excerpt(markdown: Column) -> Column:
    """What a web search hands on: the first characters of the page, empty on failure."""
    return F.coalesce(F.substring(markdown, 1, SEARCH_CHARS), F.lit(""))


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str], delay_s: float = REQUEST_DELAY, columns: tuple[str, ...] = ("url",)) -> DataFrame:
    """urls with body and error. A host's urls are one partition's, which waits delay_s between its requests, so no host is asked
    more often than that however many machines there are; a failed request fills `error` and goes on."""
    import pandas as pd

    def load(batches):
        last = 0.0
        for pdf in batches:
            bodies, errors = [], []
            for u in pdf["url"]:
                time.sleep(max(0.0, last + delay_s - time.monotonic()))
                last = time.monotonic()
                try:
                    body, error = fetch(u), None
                except Exception as e:  # noqa: BLE001 - one request must not fail the others
                    body, error = None, f"{type(e).__name__}: {e}"
                bodies.append(body)
                errors.append(error)
            yield pd.DataFrame({**{c: pdf[c] for c in columns}, "body": bodies, "error": errors})

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1))
    return urls.select(*columns).repartition(host).mapInPandas(load, ", ".join([f"{c} string" for c in columns] + ["body string", "error string"]))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """files: name, content (bytes), and what else. Executors write each file under its name in a folder that all share (a path or URI that pyarrow knows).

    Adds path and error (a failed write doesn't fail the others). A file is written under a name of its own and moved, so it is
    there whole or not at all, however often a task runs; null contents aren't written. It runs when its rows are read.
    """
    import pandas as pd

    def write(batches):
        import uuid

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for pdf in batches:
            paths, errors = [], []
            for name, content in zip(pdf["name"], pdf["content"]):
                path = error = None
                if content is not None:
                    try:
                        if not name or "/" in name or name in (".", ".."):
                            raise ValueError(f"not a file name: {name!r}")
                        path, draft = f"{root}/{name}", f"{root}/.{uuid.uuid4().hex}"
                        with where.open_output_stream(draft) as out:
                            out.write(bytes(content))
                        where.move(draft, path)
                    except Exception as e:  # noqa: BLE001 - one file must not fail the others
                        path, error = None, f"{type(e).__name__}: {e}"
                paths.append(path)
                errors.append(error)
            yield pd.DataFrame({**{c: pdf[c] for c in kept}, "path": paths, "error": errors})

    kept = [c for c in files.columns if c not in ("content", "path", "error")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name in kept), "path string", "error string"])
    return files.mapInPandas(write, schema)


def dump(results: dict[str, DataFrame], folder: str) -> None:
    """A crawl's tables as JSON lines, one folder each, other than ASCII characters as they are."""
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
