"""HTML to text with links, as an Arrow-batched function over the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from lodeworks.functions.models import HtmlExtractor

# Elements without text (void ones have no end tag, so they stand apart), elements that end a line,
# characters that are deleted: zero width space, non-joiner and joiner, no-break space, byte order mark.
DROPPED = {"script", "style", "head", "noscript"}
VOID_DROPPED = {"meta", "link"}
LINE_ENDS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6"}
INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x00A0, 0xFEFF))
# By the HTML standard: what may stand in a head, what ends an open paragraph, and what each start tag ends up to which parents.
_IN_HEAD = {"title", "base", "template", "html", "head", *VOID_DROPPED, "script", "style", "noscript"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_TRACKED = LINE_ENDS - {"br"} | {"ul", "ol", "table", "td", "th", "body", "section", "article"}


class _Reader(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.links = base, [], []
        self.dropped, self.open, self.href, self.label = [], [], None, []

    def _end(self, at: int):
        """Ends the open elements from a place on, the innermost first."""
        for tag in reversed(self.open[at:]):
            if tag in LINE_ENDS:
                self._put("\n")
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if self.dropped == ["head"] and tag not in _IN_HEAD:
            self.dropped = []  # an omitted </head>
        if tag in VOID_DROPPED:
            return
        if tag in DROPPED:
            self.dropped.append(tag)
        elif not self.dropped:
            if tag == "a":
                if self.href is not None:
                    self._link()
                self.href, self.label = dict(attrs).get("href"), []
            elif tag == "br":
                self._put("\n")
            if tag in _ENDS_P and "p" in self.open:
                self._end(len(self.open) - 1 - self.open[::-1].index("p"))
            ends, parents = _ENDS.get(tag, ((), ()))
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at] in parents:
                    break
                if self.open[at] in ends:
                    self._end(at)
            if tag in _TRACKED:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            if tag in self.dropped:
                del self.dropped[self.dropped.index(tag) :]
        elif not self.dropped:
            if tag == "a":
                if self.href is not None:
                    self._link()
            elif tag in self.open:
                self._end(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        if not self.dropped:
            self._put(data)

    def _put(self, x):
        (self.out if self.href is None else self.label).append(x)

    def _link(self):
        href, label = (self.href or "").strip().strip("\"'").strip(), "".join(x.strip() for x in self.label)
        self.href = None
        href = self.base + href if href.startswith("/") else href
        if ".pdf" in href.lower():
            if href not in self.links:
                self.links.append(href)
            self.out.append(f"{label} [PDF]" if label else "[PDF]")
        else:
            self.out.append(f"{label} ({href})" if label and label != href else href or label)

    def close(self):
        super().close()
        if self.href is not None:
            self._link()
        self._end(0)


def html_to_text(html: str | None, base: str = "") -> tuple[str, list[str]]:
    if not html or not html.strip():
        return "", []
    reader = _Reader(base)
    reader.feed(html.replace("\\/", "/"))
    reader.close()
    lines = (x.translate(INVISIBLE).strip() for x in " ".join(reader.out).splitlines())
    return "\n".join(x for x in lines if x), list(dict.fromkeys(reader.links))


def html_udf(base: str = ""):
    """A column function: struct<text, pdf_links>."""

    @F.pandas_udf("text string, pdf_links array<string>")
    def convert(pages: pd.Series) -> pd.DataFrame:
        done = [html_to_text(x, base) for x in pages]
        return pd.DataFrame({"text": [t for t, _ in done], "pdf_links": [x for _, x in done]})

    return convert


def html_list_udf(base: str = ""):
    """A column function of array<string>: array<struct<text, pdf_links>>."""

    @F.pandas_udf("array<struct<text:string,pdf_links:array<string>>>")
    def convert(pages: pd.Series) -> pd.Series:
        return pd.Series([None if xs is None else [dict(zip(("text", "pdf_links"), html_to_text(x, base))) for x in xs] for xs in pages])

    return convert


#: Page pruning: the least share of a line that isn't link text, and the least number of words.
PRUNE_SHARE, PRUNE_WORDS = 0.45, 5
_SHOWN = re.compile(r"[^()]*\((?:https?|ftp|mailto):[^()]*\)")


def pruned(text: str, share: float = PRUNE_SHARE, words: int = PRUNE_WORDS) -> str:
    """Lines of a page's text without boilerplate: short ones, and those that are links for the most part."""
    kept = []
    for line in text.split("\n"):
        linked = sum(len(m) for m in _SHOWN.findall(line))
        if len(line.split()) >= words and len(line) - linked >= share * len(line):
            kept.append(line)
    return "\n".join(kept)


class StandardExtractor:
    """The HtmlExtractor of this module: text by html_to_text, without lines that are boilerplate, and all PDF links."""

    def __init__(self, base: str = ""):
        self.base = base

    def extract(self, html: str) -> tuple[str, list[str]]:
        text, links = html_to_text(html, self.base)
        return pruned(text), links


def page_udf(base: str = "", extractor: HtmlExtractor | None = None):
    """A column function of a rendered page: struct<text, pdf_links>, by an extractor; a page it fails on is empty."""
    extractor = extractor or StandardExtractor(base)

    def one(html):
        try:
            return extractor.extract(html or "")
        except Exception:  # noqa: BLE001 - a broken page must not fail its batch
            return "", []

    @F.pandas_udf("text string, pdf_links array<string>")
    def scan(pages: pd.Series) -> pd.DataFrame:
        done = [one(x) for x in pages]
        return pd.DataFrame({"text": [t for t, _ in done], "pdf_links": [list(x) for _, x in done]})

    return scan
