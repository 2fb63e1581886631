"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions. For each kind, `regexp_extract_all` gives the matches and `split` by the
same pattern gives what lies between them, so positions are running sums of code-point lengths.
Patterns are possessive and anchored by look-behind where a plain one would rescan or recurse: time is
linear in the text, and long runs of one character can't overflow the matcher's stack.

Defined results: a null text counts as empty (no spans, SHA-256 of the empty string); repeated rows
give repeated results; an empty table gives an empty one; input columns beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds in listed order; the first four are the base kinds, whose spans always stay.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
KINDS = BASE + ADDED

#: Leftmost non-overlapping matches, without rescans. A card is a whole chain of digits joined by
#: single blanks or hyphens, so its neighbours may not extend the chain.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?=[a-zA-Z]*[0-9])[A-Za-z0-9]{16,64}(?![A-Za-z0-9])",
}
#: Characters without which a kind can't match, to skip its pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Words that speak for a kind if they stand within WINDOW code points before or after a span, up to the next match of its
#: kind on that side: English, German, French and Spanish.
CONTEXT = {
    "email": "mail|contact|kontakt|contacto|correo|courriel|adresse|write|schreib",
    "ip": r"\bip\b|addr|host|server|serveur|servidor|rechner",
    "card": "card|visa|master|credit|pay|karte|kredit|carte|tarjeta|paiement|pago|zahl",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|anruf|handy|téléphon|portable|appel|teléfono|móvil|llam",
    "iban": "iban|bank|account|konto|compte|cuenta|banque|banco",
    "ssn": "ssn|social|security|sozial|versicher|sécurité|seguridad|seguro",
    "secret": "token|secret|passw|api.?key|credential|apikey|geheim|kennwort|mot de passe|clé|clave|contraseña",
}
#: Score of a confirmed span without context, and what a context word adds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.2}
BONUS, WINDOW, LEAST = 0.4, 40, 0.5
_BLOCK = 256
#: Code points of a slab, of which a masked text is put together.
_SLAB = 2048


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Luhn over the digits of x: from the right, every second digit doubled, less 9 if over 9."""
    each = F.transform(
        F.split(F.reverse(_digits(x)), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _mod97(x: Column) -> Column:
    """ISO 7064: the first four characters to the end, letters as 10 to 35, remainder 1."""
    bare = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.coalesce(c.cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return (rest == 1) & F.length(bare).between(15, 34)


def _confirmed(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {
        "ip": lambda: ~F.exists(F.split(x, r"\."), lambda p: ~p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)$")),
        "card": lambda: n.between(14, 19) & _luhn(x),
        "phone": lambda: n.between(10, 15),
        "iban": lambda: _mod97(x),
        "ssn": lambda: ~x.rlike("^(?:000|666|9)|-00-|-0000$"),
        "secret": lambda: x.rlike("[A-Za-z]"),
    }.get(kind, lambda: F.lit(True))()


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: the optimizer would else copy it into lambdas, to run for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(steps: Column) -> Column:
    """Exclusive running sums of an array by blocks: for n elements, n * _BLOCK + (n / _BLOCK) ** 2 additions."""
    add = lambda a, x: a + x
    blocks = lambda each: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(each) / _BLOCK).cast("int") - 1, F.lit(0))),
        lambda b: F.aggregate(F.slice(each, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add),
    )
    before = lambda each: _let(blocks(each), lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), add)))
    return _let(
        steps,
        lambda each: _let(
            before(each),
            lambda at: F.transform(
                each,
                lambda _, i: F.element_at(at, F.floor(i / _BLOCK).cast("int") + 1) + F.aggregate(F.slice(each, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK), F.lit(0), add),
            ),
        ),
    )


def _proposed(df: DataFrame, kind: str, no: int) -> DataFrame:
    """Adds _kind: confirmed spans of the kind as structs (start, no, stop, kind, score)."""
    may = F.col("_text").contains(NEEDS[kind]) if kind in NEEDS else F.col("_text").rlike("[0-9]")
    df = df.withColumn(f"_{kind}_m", F.when(may, F.regexp_extract_all("_text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"_{kind}_s", F.when(F.size(f"_{kind}_m") > 0, F.split("_text", PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>")))
    # each match with the text before it and after it, up to the matches of its kind there
    pairs = F.zip_with(F.slice(f"_{kind}_s", F.lit(1), F.size(f"_{kind}_m")), f"_{kind}_m", lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    pairs = F.zip_with(pairs, F.slice(f"_{kind}_s", F.lit(2), F.size(f"_{kind}_m")), lambda p, a: F.struct(p["s"].alias("s"), p["m"].alias("m"), a.alias("a")))
    df = df.withColumn(f"_{kind}_p", pairs)
    df = df.withColumn(f"_{kind}_at", _running(F.transform(f"_{kind}_p", lambda p: F.length(p["s"]) + F.length(p["m"]))))
    near = lambda p: F.lower(F.right(p["s"], F.lit(WINDOW))).rlike(CONTEXT[kind]) | F.lower(F.left(p["a"], F.lit(WINDOW))).rlike(CONTEXT[kind])
    spans = F.zip_with(
        f"_{kind}_p",
        f"_{kind}_at",
        lambda p, at: F.struct(
            (at + F.length(p["s"])).alias("start"),
            F.lit(no).alias("no"),
            (at + F.length(p["s"]) + F.length(p["m"])).alias("stop"),
            F.lit(kind).alias("kind"),
            F.when(_confirmed(kind, p["m"]), F.lit(PRIOR[kind]) + F.when(near(p), F.lit(BONUS)).otherwise(F.lit(0.0))).otherwise(F.lit(-1.0)).alias("score"),
        ),
    )
    least = 0.0 if kind in BASE else LEAST
    df = df.withColumn(f"_{kind}", F.filter(spans, lambda x: x["score"] >= least))
    return df.drop(*(f"_{kind}_{x}" for x in ("m", "s", "p", "at")))


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """docs with one more column: spans array<struct<start,no,stop,kind,score>>, by start, then kind.

    Base kinds keep every confirmed span. Added kinds need a score of LEAST from checksum and context,
    and give way where they overlap a base span.
    """
    held = [c for c in docs.columns if c != out]
    df = docs.select(F.struct(*held).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for no, kind in enumerate(KINDS):
        df = _proposed(df, kind, no)
    df = df.withColumn("_base", F.concat(*(f"_{k}" for k in BASE)))
    more = F.filter(F.concat(*(f"_{k}" for k in ADDED)), lambda x: ~F.exists("_base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    df = df.select("_row", F.array_sort(F.concat("_base", more)).alias("_spans"))
    return df.select("_row.*", F.col("_spans").alias(out))


def spell(spans: Column) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; a span that overlaps one before it adds nothing of its own but its end. Null stays null."""
    found = find_pii(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_plain")), "_plain", "_found")
    # Spans joined where they overlap; by kind, spans don't overlap, so few of them overlap any one.
    last = lambda all_, i: F.array_max(F.transform(F.slice(all_, F.greatest(i - 15, F.lit(1)), F.least(i, F.lit(16))), lambda y: y["stop"]))
    cuts = _let(
        F.col("_found"),
        lambda all_: F.filter(
            F.transform(all_, lambda x, i: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), F.when(i == 0, F.lit(0)).otherwise(last(all_, i)).alias("free"))),
            lambda x: x["stop"] > x["free"],
        ),
    )
    # Texts are cut into slabs once, so that no span costs a walk from the text's start.
    slabs = F.regexp_extract_all("_plain", F.lit(f"(?s).{{1,{_SLAB}}}+"), F.lit(0))

    def between(held, start, stop):
        first = F.floor(start / _SLAB).cast("int")
        near = F.array_join(F.slice(held, first + 1, F.floor(stop / _SLAB).cast("int") - first + 1), "")
        return F.when(stop > start, F.substring(near, start - first * _SLAB + 1, stop - start)).otherwise("")

    end = F.array_max(F.transform("_found", lambda y: y["stop"]))
    piece = lambda held: lambda x: F.concat(between(held, x["free"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    clean = F.when(F.size("_found") == 0, F.col("_plain")).otherwise(
        _let(slabs, lambda held: F.concat(F.array_join(F.transform(cuts, piece(held)), ""), between(held, end, F.length("_plain"))))
    )
    found = found.select("_doc", clean.alias("_clean"))
    return found.select(*(F.col("_clean").alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs)
    base = F.filter("pii_spans", lambda x: x["no"] < len(BASE))
    many = lambda no: F.size(F.filter("pii_spans", lambda x: x["no"] == no)).cast("long")
    return found.select(
        "doc_id",
        *(many(no).alias(f"n_{kind}") for no, kind in enumerate(BASE)),
        F.sha2(spell(base), 256).alias("base_sha256"),
        spell(F.col("pii_spans")).alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("pii_spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )
