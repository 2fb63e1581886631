import pytest
from pyspark.sql import functions as F

from lodeworks.sources import crawl


@pytest.mark.parametrize(
    "url,form",
    [
        ("HTTP://Example.COM/A/b/", "http://example.com/A/b"),
        ("https://e.com:443/x#top", "https://e.com/x"),
        ("http://e.com:443/?q=1#f", "http://e.com:443?q=1"),
        (" https://e.com ", "https://e.com"),
        ("mailto:a@b.c", None),
        ("javascript:void(0)", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_form(spark, url, form):
    assert spark.createDataFrame([(url,)], "u string").select(crawl.canonical_url(F.col("u"))).first()[0] == form


def test_links_are_read_as_on_their_page(spark):
    page = "https://e.com/a/b.html?x=1"
    html = """<a class=x href="c.html">1</a><A HREF='/d/'>2</A><a href="//o.org/e">3</a><a href="?p=2&amp;q=3">4</a><a href="#top">5</a>
    <a href="mailto:x@y.z">6</a><link href="/style.css"><a href="https://E.com/d">7</a><a href="">8</a>"""
    found = crawl.links_of(spark.createDataFrame([(page, html), ("https://e.com", '<a href="z">'), (page, None)], "url string, html string"))
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted([(page, x) for x in ("https://e.com/a/c.html", "https://e.com/d", "https://o.org/e", "https://e.com/a/b.html?p=2&q=3", "https://e.com/a/b.html")] + [("https://e.com", "https://e.com/z")])


def test_depth_is_that_of_the_first_round_and_nothing_is_loaded_twice(spark):
    site = {"/": ["/a", "/b", "/"], "/a": ["/b", "/c"], "/b": ["/hub"], "/c": ["/hub", "/d"], "/d": ["/far"], "/hub": [f"/x{i}" for i in range(50)], **{f"/x{i}": ["/hub", "/"] for i in range(50)}}
    pages = spark.createDataFrame([("https://e.com" + (k if k != "/" else ""), "".join(f'<a href="{x}">' for x in v)) for k, v in site.items()], "url string, html string")
    loaded = []

    def load(asked):
        loaded.append(sorted(r["url"] for r in asked.collect()))
        return pages.join(asked, "url")

    seeds = spark.createDataFrame([("https://E.com/",), ("https://e.com#x",), (None,)], "url string")
    got = {r["url"].removeprefix("https://e.com"): r["depth"] for r in crawl.crawl(seeds, load, 4).collect()}
    assert got == {"": 0, "/a": 1, "/b": 1, "/c": 2, "/hub": 2, "/d": 3, "/far": 4, **{f"/x{i}": 3 for i in range(50)}}
    every = [u for x in loaded for u in x]
    assert len(every) == len(set(every)) and len(loaded) == 4
    few = crawl.crawl(seeds, lambda asked: pages.join(asked, "url"), 9, follow=lambda u: ~u.contains("/x"))
    assert {r["url"] for r in few.collect()} == {"https://e.com" + x for x in ("", "/a", "/b", "/c", "/hub", "/d", "/far")}
    assert crawl.crawl(seeds.limit(0), load, 2).isEmpty() and crawl.crawl(seeds, load, 0).count() == 1
