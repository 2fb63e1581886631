"""Column expressions over text, ids and vectors. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of URL-based UUIDs (RFC 4122), prefix of cache keys.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
# Starts of questions that depend on context, and the least length to cache.
CONTEXT_KEYWORDS = ["nasıl", "ne zaman", "nerede", "hangi", "kaç", "bu", "o", "onun", "bunun", "peki", "ya"]
MIN_CACHE_LENGTH = 10
# Substrings of links that aren't shown.
SKIPPED_LINKS = ["type=get", "type=list", "servlet/announcement", "servlet/content", "servlet/staff", "servlet/menu"]
REWRITE_MAX_WORDS = 6
REWRITE_MAX_CHARS = 200


def strip(x: Column) -> Column:
    """Without white space at both ends, any Unicode white space counted."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def cache_key(question: Column, prefix: str = "cache:") -> Column:
    return F.concat(F.lit(prefix), F.md5(F.lower(strip(question)).cast("binary")))


def point_id(source_key: Column, doc_id: Column, chunk_index: Column) -> Column:
    """Version-5 UUID of `source_key:doc_id:chunk_index` in the URL namespace."""
    name = F.concat_ws(":", source_key, doc_id.cast("string"), chunk_index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def clean_answer(x: Column, rules: list[tuple[str, str]] = ()) -> Column:
    """Drops reasoning blocks, applies (pattern, replacement) rules in order, and strips."""
    x = F.regexp_replace(x, r"(?s)<think>.*?</think>", "")
    for pattern, to in rules:
        x = F.regexp_replace(x, pattern, to)
    return strip(x)


def name_rules(name: str, misspelt: list[str], pronoun: str) -> list[tuple[str, str]]:
    """Rules for clean_answer, in order: an assistant's misspellings of a name become the name, in any case; one
    that follows the pronoun takes it along; the name's upper-case form with a plain I is mended; and a pronoun
    that leads a line is dropped."""
    return [
        *((rf"(?iuU)\b{pronoun}\s+{m}", name) for m in misspelt[:1]),
        *((rf"(?iuU)\b{m}\b", name) for m in misspelt[1:]),
        (rf"(?U)\b{name.replace(name[0], 'I', 1)}\b", name),
        (rf"(?mU)^{pronoun}\s+", ""),
    ]


def fill_template(template: str, **values: Column) -> Column:
    """A url template with {name} places filled in."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def is_local_file(url: Column) -> Column:
    return F.coalesce(url.startswith("file://"), F.lit(False))


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, to three places."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 3)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, the nearest ones (halves to the even), as epoch(ts)::BIGINT gives in SQL."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


def word_count(x: Column) -> Column:
    s = strip(x)
    return F.when(F.length(s) == 0, 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def should_cache(question: Column) -> Column:
    q = F.lower(strip(question))
    starts = F.lit(False)
    for k in CONTEXT_KEYWORDS:
        starts = starts | q.startswith(k)
    return (F.length(q) >= MIN_CACHE_LENGTH) & ~starts


def rewrite_gate(question: Column, history_size: Column) -> Column:
    """True where a question is short enough, and has a history, to be rewritten."""
    return (history_size > 0) & (word_count(question) <= REWRITE_MAX_WORDS)


def rewrite_or_original(rewritten: Column, original: Column) -> Column:
    r = strip(rewritten)
    return F.when((F.length(r) == 0) | (F.length(r) > REWRITE_MAX_CHARS) | r.isNull(), original).otherwise(r)


def link_admissible(url: Column) -> Column:
    ok = F.coalesce(url.startswith("http"), F.lit(False))
    for s in SKIPPED_LINKS:
        ok = ok & ~url.contains(s)
    return ok


def is_pdf_link(href: Column) -> Column:
    return F.lower(href).contains(".pdf")


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def safe_filename(url: Column, default: str = "document") -> Column:
    last = F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("?"), F.lit(1))
    safe = F.regexp_replace(last, r"(?U)[^\w.\-]", "_")
    return F.when(F.length(safe) > 0, safe).otherwise(default)


def unescape_basic(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def json_body(page: Column) -> Column:
    """JSON text of a page: the first <pre> body, if any, with entities restored."""
    pre = F.regexp_extract(page, r"(?s)<pre[^>]*>(.*?)</pre>", 1)
    return unescape_basic(F.when(F.length(pre) > 0, pre).otherwise(page))


def first_truthy(*xs: Column) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))


def json_field_pick(record: Column) -> Column:
    """Of a JSON object in text: text, content or body; if that is JSON itself, its (first) text."""
    raw = first_truthy(*(F.get_json_object(record, f"$.{k}") for k in ("text", "content", "body")))
    lead = F.left(strip(raw), F.lit(1))
    inner = F.when(lead == "[", F.get_json_object(raw, "$[0].text")).when(lead == "{", F.get_json_object(raw, "$.text"))
    return F.coalesce(inner, raw)


# The labels of a staff line.
def staff_line(name: Column, title: Column, unit: Column, duty: Column, mail: Column, phone: Column) -> Column:
    some = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(" | ", some(name), some(title), some(unit), F.concat(F.lit("Görev: "), some(duty)), F.concat(F.lit("E-posta: "), some(mail)), F.concat(F.lit("Tel: "), some(phone)))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 where a norm is 0."""
    add = lambda s, v: s + v
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), add)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
