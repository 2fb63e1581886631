"""A crawl to a depth: rounds of links found on the last round's pages, met by what was visited before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.shared import written

#: Addresses up to which a round's frontier goes to all machines.
FRONTIER_ROWS = 100_000


def canonical_url(url: Column) -> Column:
    """One form of an address: scheme and host in lower case, without the scheme's own port, fragment, and slashes at the end; null for what is no http address."""
    whole = F.regexp_extract(url, r"^\s*([A-Za-z]+)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?", 0) != ""
    part = lambda n: F.regexp_extract(url, r"^\s*([A-Za-z]+)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?", n)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), F.when(scheme == "http", F.lit(":80$")).otherwise(F.lit(":443$")), F.lit(""))
    path = F.regexp_replace(part(3), "/+$", "")
    return F.when(whole & scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, path, part(4)))


def absolute(link: Column, page: Column) -> Column:
    """A link as a browser reads it on a page: with a scheme, from the host's root, from the page's folder, or with the page's scheme."""
    site = F.regexp_extract(page, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z]+://[^/?#]+(?:/[^?#]*)?/)", 1)
    bare = F.regexp_extract(page, r"^[^?#]*", 0)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page, "^([A-Za-z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?") | link.startswith("#") | (link == ""), F.concat(bare, link))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(site, F.lit("/"))), link))
    )


def links_of(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages -> url, link: the distinct canonical addresses of the anchors of each page."""
    raw = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    each = pages.select(F.col(url).alias("url"), F.explode(F.array_distinct(raw)).alias("raw"))
    raw = F.replace(F.trim("raw"), F.lit("&amp;"), F.lit("&"))
    return each.select("url", canonical_url(absolute(raw, F.col("url"))).alias("link")).filter("link IS NOT NULL").distinct()


def crawl(seeds: DataFrame, load: Callable[[DataFrame], DataFrame], depth: int, follow: Callable[[Column], Column] | None = None) -> DataFrame:
    """seeds: url. Returns url (canonical) and depth, the round in which it was first reached; depth 0 are the seeds.

    load takes a frontier (url) and returns pages (url as in the frontier, html) of those addresses that have any: a join
    with a table of pages, or `fetch_pages`. follow: which links are followed. Each round's addresses are distinct and
    not visited before, by an anti join, so a page that all link to is one row, and no address is loaded twice. A round is
    written to the shared folder: it isn't loaded again for the next one, nor if an executor is lost.
    """
    frontier = written(seeds.select(canonical_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for n in range(1, depth + 1):
        few = frontier.limit(FRONTIER_ROWS + 1).count() <= FRONTIER_ROWS
        asked = frontier.select("url")
        found = links_of(load(F.broadcast(asked) if few else asked)).select(F.col("link").alias("url"))
        if follow is not None:
            found = found.filter(follow(F.col("url")))
        frontier = written(found.distinct().join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(n)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
