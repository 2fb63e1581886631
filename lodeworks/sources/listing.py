"""format("listing"): a paginated JSON listing, newest page first, as a batch and a streaming source.

Pages are numbered from 1; each is a JSON list of objects with an `id`, and ids don't grow from one page to the next.
A page that is missing, empty or no list ends the listing. Which pages are read is found by doubling and halving, a few
requests however long the listing is; the pages themselves are fetched by tasks, PAGES of them each. `id > w` and
`id >= w` are pushed down: pages beyond the first whose ids are all known aren't fetched.

Items without an id, or with one that is no whole number, are left out (rows of `delta`'s quarantine come from the
listing itself, not from here). Option `folder`: page_<n>.json files; subclasses may fetch elsewhere.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, GreaterThanOrEqual, InputPartition

#: Pages that a task fetches.
PAGES = 20


def parse_listing(body: str) -> list[dict]:
    try:
        found = json.loads(body)
    except ValueError:
        return []
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def _id(item: dict) -> int | None:
    try:
        return int(item["id"])
    except (KeyError, TypeError, ValueError):
        return None


class PageRange(InputPartition):
    """Pages first..last, of which rows with low < id <= high count; None: no bound."""

    def __init__(self, first: int, last: int, low: int | None, high: int | None):
        super().__init__((first, last, low, high))
        self.first, self.last, self.low, self.high = first, last, low, high


class Listing:
    def __init__(self, fetch: Callable[[int], str], pages: int = PAGES):
        self.fetch, self.pages = fetch, pages

    def items(self, page: int) -> list[dict]:
        return parse_listing(self.fetch(page))

    def newest(self) -> int | None:
        """The largest id: of the first page that has ids."""
        page = 1
        while items := self.items(page):
            if ids := [i for i in map(_id, items) if i is not None]:
                return max(ids)
            page += 1
        return None

    def _over(self, page: int, low: int | None) -> bool:
        """Whether nothing from the next page on can count: this one is empty, or holds a known id."""
        items = self.items(page)
        ids = [i for i in map(_id, items) if i is not None]
        return not items or (low is not None and bool(ids) and min(ids) <= low)

    def last_page(self, low: int | None) -> int:
        """The first page that is the last to look at: by doubling, then halving."""
        high = 1
        while not self._over(high, low):
            high *= 2
        below = high // 2
        while high - below > 1:
            middle = (below + high) // 2
            if self._over(middle, low):
                high = middle
            else:
                below = middle
        return high

    def ranges(self, low: int | None, high: int | None = None) -> list[PageRange]:
        last = self.last_page(low)
        return [PageRange(a, min(a + self.pages - 1, last), low, high) for a in range(1, last + 1, self.pages)]

    def rows(self, part: PageRange) -> Iterator[tuple]:
        for page in range(part.first, part.last + 1):
            for x in self.items(page):
                i = _id(x)
                if i is not None and (part.low is None or i > part.low) and (part.high is None or i <= part.high):
                    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
                    yield i, text(x.get("title")), text(x.get("updated")), json.dumps(x, ensure_ascii=False)


class ListingBatch(DataSourceReader):
    def __init__(self, listing: Listing):
        self.listing, self.low = listing, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and tuple(f.attribute) == ("id",) and isinstance(f.value, int):
                low = f.value if isinstance(f, GreaterThan) else f.value - 1
                self.low = low if self.low is None else max(self.low, low)
            else:
                yield f

    def partitions(self):
        return self.listing.ranges(self.low)

    def read(self, partition):
        return self.listing.rows(partition)


class ListingStream(DataSourceStreamReader):
    """An offset is the largest id seen. A batch between two offsets holds the same rows whenever it is read, as ids in it, not pages, bound it."""

    def __init__(self, listing: Listing, since: int):
        self.listing, self.since, self.seen = listing, since, since

    def initialOffset(self):
        return {"max_id": self.since}

    def latestOffset(self):
        newest = self.listing.newest()
        self.seen = max(self.seen, newest if newest is not None else self.seen)
        return {"max_id": self.seen}

    def partitions(self, start, end):
        if end["max_id"] <= start["max_id"]:
            return []
        return self.listing.ranges(start["max_id"], end["max_id"])

    def read(self, partition):
        return self.listing.rows(partition)


class ListingSource(DataSource):
    """Options: folder; pages_per_task; since, the id after which a stream begins (0)."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return "id long, title string, updated string, raw string"

    def fetcher(self) -> Callable[[int], str]:
        folder = self.options["folder"]

        def fetch(page: int) -> str:
            try:
                with open(f"{folder}/page_{page}.json", encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return "[]"

        return fetch

    def listing(self) -> Listing:
        return Listing(self.fetcher(), int(self.options.get("pages_per_task", PAGES)))

    def reader(self, schema):
        return ListingBatch(self.listing())

    def streamReader(self, schema):
        return ListingStream(self.listing(), int(self.options.get("since", 0)))


def register(spark: SparkSession, source: type[ListingSource] = ListingSource) -> None:
    """The source under its name, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
