"""Page pruning by block density, in the JVM: a page's blocks as rows, scored with their neighbours.

A block is what stands between two block-level tags. Its score weighs how dense its text is in its markup, how much of it
is outside links, and what its tag is for; a block counts with its neighbours (its own score twice), so that a plain
line inside an article stays. Neighbours don't lift what is link text for the most part or stands in a tag of little worth. Tags need not be balanced: a broken page has blocks too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least score, the least number of words of a block that stays.
LEAST_SCORE, LEAST_WORDS = 0.45, 5
#: What a block's tag is worth, and the worth of text after any other tag.
WORTH = {"p": 1.0, "article": 1.0, "main": 1.0, "section": 0.8, "blockquote": 0.8, "pre": 0.8, "td": 0.6, "li": 0.5, "h1": 0.9, "h2": 0.9, "h3": 0.8, "nav": 0.0, "footer": 0.0, "header": 0.2, "aside": 0.1, "form": 0.1}
PLAIN = 0.5
W_DENSITY, W_LINKS, W_TAG = 0.3, 0.3, 0.4
#: What has no text: comments, and elements that aren't shown.
HIDDEN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}[^>]*>" for t in ("script", "style", "head", "noscript"))
EDGE = r"(?i)<(/?(?:p|div|li|tr|td|th|h[1-6]|ul|ol|dl|dt|dd|table|section|article|header|footer|nav|main|aside|form|br|hr|blockquote|pre|body|html))\b[^>]*>"
LINK, TAG, BLANKS = r"(?is)<a\b[^>]*>(.*?)</a[^>]*>", r"<[^>]*>", r"[ \t\n\r\f]+"
#: Entities that are spelled out; `&amp;` is last, so that no new entity arises.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def shown(markup: Column) -> Column:
    """The text of a piece of markup on one line."""
    text = F.regexp_replace(markup, TAG, " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """A row a block with text: page_id, seq, tag (empty after an end tag), text, words, density, linked (share of its text in links), score and smooth."""
    whole = F.regexp_replace(F.col(html), HIDDEN, " ")
    cut = pages.select(F.col(page_id).alias("page_id"), F.split(whole, EDGE, -1).alias("_pieces"), F.transform(F.regexp_extract_all(whole, F.lit(EDGE), F.lit(1)), lambda t: F.lower(t)).alias("_tags"))
    rows = cut.select("page_id", "_tags", F.posexplode("_pieces").alias("seq", "_piece"))
    tag = F.coalesce(F.get("_tags", F.col("seq") - 1), F.lit(""))
    rows = rows.select("page_id", "seq", F.when(tag.startswith("/"), "").otherwise(tag).alias("tag"), "_piece", shown(F.col("_piece")).alias("text")).filter(F.length("text") > 0)
    chars = F.length("text").cast("double")
    markup = (F.length("_piece") - F.length(F.regexp_replace("_piece", TAG, ""))).cast("double")
    inside = F.length(shown(F.array_join(F.regexp_extract_all("_piece", F.lit(LINK), F.lit(1)), " "))).cast("double")
    worth = F.lit(PLAIN)
    for name, value in WORTH.items():
        worth = F.when(F.col("tag") == name, value).otherwise(worth)
    rows = rows.select("page_id", "seq", "tag", "text", worth.alias("_worth"), F.size(F.split("text", " ")).alias("words"), (chars / (chars + markup)).alias("density"), F.least(inside / chars, F.lit(1.0)).alias("linked"))
    rows = rows.withColumn("score", F.col("density") * W_DENSITY + (1 - F.col("linked")) * W_LINKS + F.col("_worth") * W_TAG)
    w = Window.partitionBy("page_id").orderBy("seq")
    around = F.coalesce(F.lag("score").over(w), F.col("score")) + F.col("score") * 2 + F.coalesce(F.lead("score").over(w), F.col("score"))
    alone = (F.col("linked") > 0.5) | (F.col("_worth") < PLAIN)
    return rows.withColumn("smooth", F.when(alone, F.least("score", around / 4)).otherwise(around / 4)).drop("_worth")


def stays(least: float = LEAST_SCORE, words: int = LEAST_WORDS) -> Column:
    return (F.col("smooth") >= least) & (F.col("words") >= words)


#: What stands before a block of a tag in Markdown.
MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- ", "blockquote": "> "}


def marked(tag: Column, text: Column) -> Column:
    """A block as Markdown."""
    mark = F.lit("")
    for name, m in MARKS.items():
        mark = F.when(tag == name, m).otherwise(mark)
    return F.concat(mark, text)


def pruned_text(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: float = LEAST_SCORE, words: int = LEAST_WORDS, markdown: bool = False) -> DataFrame:
    """page_id, text (the blocks that stay, a line each, in order; as Markdown with empty lines between), blocks (all with text) and kept. A page without text has a row too; rows of one page_id are one page."""
    rows = blocks(pages, page_id, html).withColumn("_stays", stays(least, words))
    shown_as = marked(F.col("tag"), F.col("text")) if markdown else F.col("text")
    lines = F.array_sort(F.collect_list(F.when(F.col("_stays"), F.struct("seq", shown_as.alias("text")))))
    some = rows.groupBy("page_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n" if markdown else "\n").alias("text"), F.count("*").alias("blocks"), F.count_if("_stays").alias("kept"))
    every = pages.select(F.col(page_id).alias("page_id")).distinct().join(some, "page_id", "left")
    return every.select("page_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def text(markup: str) -> str:
        out = f"regexp_replace({markup}, {quote(TAG)}, ' ', 'g')"
        for entity, char in ENTITIES.items():
            out = f"replace({out}, {quote(entity)}, {quote(char)})"
        return f"trim(regexp_replace({out}, {quote(BLANKS)}, ' ', 'g'), ' ')"

    worth = "CASE tag " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WORTH.items()) + f" ELSE {PLAIN}::DOUBLE END"
    return f"""WITH h AS (SELECT page_id, regexp_replace(html, {quote(HIDDEN)}, ' ', 'g') AS h FROM pages),
c AS (SELECT page_id, string_split_regex(h, {quote(EDGE)}) AS pieces, regexp_extract_all(h, {quote(EDGE)}, 1) AS tags FROM h),
p AS (SELECT page_id, unnest(pieces) AS piece, unnest(list_prepend('', tags)) AS t, generate_subscripts(pieces, 1) - 1 AS seq FROM c),
b AS (SELECT page_id, seq, CASE WHEN starts_with(t, '/') THEN '' ELSE lower(t) END AS tag, piece, {text('piece')} AS text FROM p),
m AS (SELECT *, length(text)::DOUBLE AS chars, (length(piece) - length(regexp_replace(piece, {quote(TAG)}, '', 'g')))::DOUBLE AS markup, length({text(f"array_to_string(regexp_extract_all(piece, {quote(LINK)}, 1), ' ')")})::DOUBLE AS inside FROM b WHERE length(text) > 0),
s AS (SELECT *, chars / (chars + markup) * {W_DENSITY}::DOUBLE + (1 - least(inside / chars, 1.0::DOUBLE)) * {W_LINKS}::DOUBLE + {worth} * {W_TAG}::DOUBLE AS score, least(inside / chars, 1.0::DOUBLE) > 0.5 OR {worth} < {PLAIN} AS alone FROM m),
w AS (SELECT *, (coalesce(lag(score) OVER o, score) + score * 2 + coalesce(lead(score) OVER o, score)) / 4 >= {LEAST_SCORE}::DOUBLE AND (NOT alone OR score >= {LEAST_SCORE}::DOUBLE) AND len(string_split(text, ' ')) >= {LEAST_WORDS} AS stays FROM s WINDOW o AS (PARTITION BY page_id ORDER BY seq))
SELECT g.page_id, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (stays), '') AS text, count(w.page_id) AS blocks, count(*) FILTER (stays) AS kept FROM pages g LEFT JOIN w ON w.page_id = g.page_id GROUP BY g.page_id"""


SQL = _sql()
