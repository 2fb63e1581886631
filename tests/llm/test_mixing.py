import random
from fractions import Fraction

from pyspark.sql import functions as F

from lodeworks.llm import mixing


def brute(caps, weights, b):
    """Fill in proportion to the weights, no child beyond its capacity; whole numbers by floor for those not full."""
    left = dict(caps)
    full = set()
    while True:
        rest, w = b - sum(caps[x] for x in full), sum(weights[x] for x in left if x not in full)
        more = {x for x in left if x not in full and Fraction(rest * weights[x], w) >= caps[x]} if w else set()
        if not more:
            return {x: caps[x] if x in full else rest * weights[x] // w for x in caps}
        full |= more


def test_fill_equals_brute_force(spark):
    r = random.Random(5)
    rows, want = [], {}
    for p in range(40):
        kids = [(f"n{k}", r.choice([1, 2, 2, 3, 5, 8, 8, 40]), r.randrange(1, 4)) for k in range(r.randrange(1, 9))]
        b = r.randrange(0, sum(c for _, c, _ in kids) + 1)
        rows += [(f"p{p}", n, c, w, b) for n, c, w in kids]
        want |= {(f"p{p}", n): v for n, v in brute({n: c for n, c, _ in kids}, {n: w for n, _, w in kids}, b).items()}
    df = spark.createDataFrame(rows, "parent string, node string, cap long, w long, b long")
    df = df.select("parent", "node", *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("cap", "w", "b")))
    got = {(x["parent"], x["node"]): int(x["budget"]) for x in mixing._fill(df, ["parent"], "node").collect()}
    assert got == want


def test_clashing_columns_pass(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "en", "src1", "a", i) for i in range(50)], "doc_id long, text string, lang string, source string, domain string, tokens int")
    got = mixing.mix_documents(docs, mixing.Mix(epochs=1, share=(1, 2)), keep_text=True)
    assert got.columns == docs.columns and 0 < got.count() < 50
