"""One ingest run: targets of a mode, what is new in the listing, chunks, vectors, and the store they go to.

    python -m lodeworks.ingest --mode full --targets targets.json --listing FOLDER --pages FOLDER --store FOLDER

--pages holds what an address answers, one file an address, named by `page_name`; a deployment passes `run` a fetch
function of its own in its place. Modes: full, daily, weekly, monthly; the listing is read in full and daily runs.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import models, parsing
from lodeworks.functions.text import fill_template
from lodeworks.operators import chunking
from lodeworks.operators.shared import written
from lodeworks.operators.store import ChunkStore
from lodeworks.sources import catalog, listing, pages
from lodeworks.settings import Settings, settings

KEY, VERSION = ["point_id"], "created_at"


def page_name(url: str) -> str:
    """The file that stands for an address."""
    return "".join(c if c.isalnum() or c in ".-" else "_" for c in url)


def folder_fetch(folder: str) -> Callable[[str], str]:
    def fetch(url: str) -> str:
        with open(f"{folder}/{page_name(url)}", encoding="utf-8") as f:
            return f.read()

    return fetch


def known_announcements(store: ChunkStore) -> int:
    """The largest announcement in the store, 0 without one."""
    held = store.read()
    if held is None:
        return 0
    mine = held.filter(F.col("source_key") == chunking.ANNOUNCEMENTS).select(F.col("metadata")["ann_id"].cast("long").alias("id"))
    return catalog.max_watermark(mine, "id").first()[0]


def announced(new: DataFrame, fetch: Callable[[str], str], detail_url: str, base: str, delay_s: float) -> DataFrame:
    """Listing items with their details, each fetched once; a failed one stays without."""
    urls = new.select("id", fill_template(detail_url, id=F.col("id")).alias("url"))
    bodies = pages.fetch_pages(urls.select(F.col("id").cast("string").alias("id"), "url"), fetch, delay_s, ("id", "url"))
    details = bodies.filter(F.col("body").isNotNull()).select(F.col("id").cast("long").alias("id"), "body")
    records = parsing.announcements(new.withColumn("url", F.get_json_object("raw", "$.url")), details, detail_url, base)
    return pages.with_pdf_texts(records, new.sparkSession.createDataFrame([], "url string, pdf_text string"))


def run(spark: SparkSession, mode: str, targets: DataFrame, store: ChunkStore, fetch: Callable[[str], str], created_at: str, items: DataFrame | None = None, detail_url: str = "", base: str = "", model: models.Embedder | None = None, own: Settings | None = None) -> dict:
    """Runs one mode and returns its counts: targets, errors, announcements, chunks. items: a listing (id, title, updated, raw).

    Running it again changes nothing: chunks have ids of their place, and announcements that are known aren't fetched. Chunks beyond a document's
    present number go.
    """
    own = own or settings(spark)
    chosen = catalog.mode_targets(targets, mode)
    bodies = pages.fetch_pages(chosen.select("key", "url"), fetch, own.request_delay_s, ("key", "url"))
    records = written(parsing.static_records(chosen, bodies.select("key", "body"), base))
    empty = "id long, title string, updated string, raw string"
    new = spark.createDataFrame([], empty)
    if items is not None and mode in ("full", "daily"):
        new = items.filter(F.col("id") > known_announcements(store))
    news = written(announced(new, fetch, detail_url, base, own.request_delay_s))
    # texts that stand for a failure are no content
    usable = news.withColumn("content", F.when(F.col("content") != parsing.NO_DETAIL, F.col("content")))
    chunks = chunking.chunk_all(usable, records.filter(F.col("error").isNull()), F.lit(created_at))
    encode = models.encode_packed(model or models.HashEmbedder(own.embedding_dim), own.token_budget)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    rows = written(chunks.mapInPandas(encode, f"{fields}, dense array<float>, sparse map<string,int>"))
    store.upsert(rows, KEY, VERSION)
    if store.read() is not None:
        store.prune(rows.groupBy("source_key", "doc_id").agg(F.max("total_chunks").alias("total_chunks")))
    failed = records.filter(F.col("error").isNotNull()).count()
    return {"mode": mode, "targets": records.count(), "errors": failed, "announcements": news.count(), "chunks": rows.count()}


def main(argv: list[str] | None = None) -> None:
    from lodeworks.session import get_session

    p = argparse.ArgumentParser(prog="python -m lodeworks.ingest", description=__doc__.split("\n")[0])
    p.add_argument("--mode", required=True, choices=["full", *catalog.FREQUENCIES])
    p.add_argument("--targets", required=True, help="JSON list of targets: key, url, crawl_type, frequency, ...")
    p.add_argument("--pages", required=True, help="folder of what addresses answer")
    p.add_argument("--store", help="folder of the chunk store; spark.lodeworks.store where it is not given")
    p.add_argument("--listing", help="folder of page_<n>.json files")
    p.add_argument("--detail-url", default="", help="address of an announcement, with {id}")
    p.add_argument("--base", default="", help="what links that begin with / are put behind")
    p.add_argument("--created-at", help="creation time of this run's chunks (UTC, ISO); now where it is not given")
    a = p.parse_args(argv)
    spark = get_session("ingest")
    own = settings(spark)
    where = a.store or own.store
    if not where:
        p.error("--store or spark.lodeworks.store must name the store")
    with open(a.targets, encoding="utf-8") as f:
        targets = catalog.catalogue(spark, json.load(f))
    items = None
    if a.listing:
        listing.register(spark)
        items = spark.read.format("listing").option("folder", a.listing).load()
    now = a.created_at or spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    print(json.dumps(run(spark, a.mode, targets, ChunkStore(spark, where), folder_fetch(a.pages), now, items, a.detail_url, a.base, own=own)))


if __name__ == "__main__":
    main()
