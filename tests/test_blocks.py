from pyspark.sql import functions as F

from lodeworks.functions import blocks
from lodeworks.sources import pages

PAGE = """<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home page of the whole site</a></li><li><a href="/b">Another page of this same site</a></li></ul></nav>
<script>var x = "<p>not a text at all, never</p>";</script><!-- <p>nor this one, it is a comment</p> -->
<article><h1>What the library is open for</h1><p>The library is open from nine to five on all days of the week, and it
 closes &amp; opens again for the night.</p><p>Short.</p><P CLASS=x>A second paragraph of the article with quite enough words in it.</P></article>
<footer>Copyright of the whole site by all of its owners <a href="/c">and one link to the terms that they set for it</a></footer></body></html>"""


def test_blocks_of_a_page(spark):
    rows = {r["text"]: r for r in blocks.blocks(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).collect()}
    body = "The library is open from nine to five on all days of the week, and it closes & opens again for the night."
    assert set(rows) == {"Home page of the whole site", "Another page of this same site", "What the library is open for", body, "Short.", "A second paragraph of the article with quite enough words in it.", "Copyright of the whole site by all of its owners and one link to the terms that they set for it"}
    assert rows[body]["tag"] == "p" and rows[body]["linked"] == 0 and rows[body]["density"] == 1 and rows[body]["words"] == 23
    menu = rows["Home page of the whole site"]
    assert menu["tag"] == "li" and menu["linked"] == 1 and menu["score"] < 0.5 < rows[body]["score"]


def test_pruning_keeps_the_article(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>unclosed <b>tags and five more words"), (5, "<<<>>> & <p <p"), (6, "x" * 5000)], "page_id long, html string")
    got = {r["page_id"]: r for r in blocks.pruned_text(df).collect()}
    assert got[1]["text"].split("\n")[0].startswith(("What the library", "The library is open")) and "second paragraph" in got[1]["text"]
    assert "Home page" not in got[1]["text"] and "Copyright" not in got[1]["text"] and "Short" not in got[1]["text"] and "comment" not in got[1]["text"]
    lines = blocks.pruned_text(df.filter("page_id = 1"), markdown=True).first()["text"].split("\n\n")
    assert lines[0] == "# What the library is open for" and lines[1].startswith("The library is open")
    assert got[4]["text"] == "unclosed tags and five more words"
    assert all(got[i]["text"] == "" for i in (2, 3, 5, 6)) and got[2]["blocks"] == 0 and got[6]["blocks"] == 1
    assert blocks.pruned_text(df.limit(0)).isEmpty()


def test_pages_by_an_extractor_of_ones_own(spark):
    class Upper:
        def extract(self, html):
            if "boom" in html:
                raise ValueError(html)
            return html.upper(), ["x.pdf"]

    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "id int, html string")
    got = {r["id"]: (r["text"], r["pdf_links"]) for r in pages.scan_pages(df, extractor=Upper()).collect()}
    assert got == {1: ("A", ["x.pdf"]), 2: ("", []), 3: ("", ["x.pdf"])}
    assert pages.scan_pages(df.withColumn("html", F.lit("<p>a line of six plain words</p>"))).first()["text"] == "a line of six plain words"
