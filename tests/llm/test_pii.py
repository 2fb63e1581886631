import hashlib
import re

from lodeworks.llm import pii


def luhn(x):
    x = [int(c) for c in x if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(x)) % 10 == 0


def digits(x):
    return sum(c.isdigit() for c in x)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= digits(m) <= 19 and luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= digits(m) <= 15),
]


def brute(text):
    found = [(m.start(), no, f"{k}:{m.start()}:{m.end()}") for no, (k, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m.group(0))]
    return [x for _, _, x in sorted(found)]


TEXTS = [
    "abc a@b.co_x@d.com 4111 1111 1111 1111 +1 (743) 555-3824 é 😀 GB82 WEST 1234 5698 7654 32 my ssn 123-45-6789",
    None,
    "",
    "1.2.3.4.5.6.7.8 256.1.1.1 010.000.0.1 1.2.3",
    "x@y x@y.z.w. @@ a@b@c.de",
    "4111-1111-1111-1111 4111 1111 1111 1112 41111111111111110000 12 4111111111111111",
    "+1 2 3 4 5 6 7 8 9 0 +12345 +1 (555) 123-4567) token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    "9" * 5000 + " " + "1." * 3000 + "a@" * 500,
    "a@b.cc " * 700,
]


def test_spans_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 2)], "doc_id int, text string, pii_spans string")
    rows = pii.find_pii(df).collect()
    assert len(rows) == len(TEXTS) * 2
    for r in rows:
        spans = r["pii_spans"]
        assert [f"{x.kind}:{x.start}:{x.stop}" for x in spans if x.kind in pii.BASE] == brute(r["text"])
    first = next(r for r in rows if r["doc_id"] == 0)
    kinds = {x.kind: r for r in [first] for x in first["pii_spans"]}
    assert {"iban", "ssn"} <= set(kinds)
    assert any(x.kind == "secret" for x in next(r for r in rows if r["doc_id"] == 6)["pii_spans"])


def test_redact_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, TEXTS[0], "k"), (2, None, "k"), (3, "", "k"), (4, "a@b.cc " * 50, "k")], "doc_id int, text string, _found string")
    rows = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert rows[1]["text"] == "abc [EMAIL][EMAIL] [CARD] [PHONE] é 😀 [IBAN] my ssn [SSN]"
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[4]["text"] == "[EMAIL] " * 50
    assert rows[1]["_found"] == "k"


def test_redact_equals_brute_force_on_long_texts(spark, monkeypatch):
    """Spans before, over and at the bounds of slabs, with code points beyond 16 bits."""
    monkeypatch.setattr(pii, "_SLAB", 16)
    texts = ["x" * k + "😀é a.b@c.de, " + "1.2.3.4 \n" * (k % 5) + "z" * (3 * k) + " +1 (743) 555-3824" * (k % 3) for k in range(70)] + ["a@b.cc", "a" * 16, "a@b.cc" + " " * 26]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {r["doc_id"]: r["s"] for r in pii.find_pii(df).selectExpr("doc_id", "pii_spans s").collect()}
    for r in pii.redact(df).collect():
        text, at, want = texts[r["doc_id"]], 0, ""
        for x in spans[r["doc_id"]]:
            if x.stop > at:
                want, at = want + text[at : x.start] + f"[{x.kind.upper()}]", x.stop
        assert r["text"] == want + text[at:]


def test_query_columns_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(5, TEXTS[0])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = pii.op2_pii(spark, str(tmp_path)).collect()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (2, 0, 1, 1)
    assert r["n_spans"] == len(r["spans"].split(",")) == 6
    assert r["base_sha256"] == hashlib.sha256(",".join(brute(TEXTS[0])).encode()).hexdigest()
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_context_counts_on_both_sides_and_in_four_languages(spark):
    texts = [
        "078-05-1120 is my social security number",
        "my ssn: 078-05-1120",
        "078-05-1120 ist meine Sozialversicherungsnummer",
        "mon numéro de sécurité sociale est 078-05-1120",
        "078-05-1120 es mi número de la seguridad",
        "a plain 078-05-1120 among other words",
        "078-05-1120 " + "x " * 40 + "social",  # too far
        "078-05-1120 a social 078-05-1121 b",  # between two: it speaks for both
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"]) for x in r["pii_spans"] if x["kind"] == "ssn"] for r in pii.find_pii(df).collect()}
    assert [len(got[i]) for i in range(8)] == [1, 1, 1, 1, 1, 0, 0, 2] and got[0] == [("ssn", 0)]
