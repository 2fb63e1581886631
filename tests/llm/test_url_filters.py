import duckdb

from lodeworks.llm import url_filters as uf

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/1", "http://example.com/en", "https://b.net/es/1?x", "http://b.net/fr/", "http://b.net/de/",
        "http://com/x", "http://xcom/en/", "a://b://c.com/d", "http://ÀB.example.com/en/\nq", "http://net?x/es/", "http://example.com"]


def test_equals_sql(spark, tmp_path):
    rows = [(i, u, "h") for i, u in enumerate(URLS * 2 + [f"http://h{i}.net/{'es' if i % 3 else 'x'}/{i}" for i in range(500)])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in uf.op7_url_filters(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(uf.SQL).fetchall())
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


def test_cascade_is_exact(spark):
    listed = [f"k{i}/" for i in range(0, 3000, 10)]
    universe = spark.createDataFrame([(f"k{i}/",) for i in range(3000)], "key string")
    levels = uf.build_cascade(listed, universe)
    got = {r["key"] for r in universe.filter(uf.listed_in(universe["key"], levels)).collect()}
    assert got == set(listed) and len(levels) > 1
    assert sum(len(x.bits) for x in levels) < 3000


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert uf.judge_urls(df, "url", [("block", "zz", "/")]).first()["verdict"] == "allow"
    assert uf.judge_urls(df.limit(0), "url").count() == 0


def test_no_column_name_clashes(spark):
    from lodeworks.llm import url_filters as uf

    names = ["_url", "_keys", "_best", "in0", "in1", "host", "key", "k"]
    df = spark.createDataFrame([("http://a.example.com/en/x", *range(len(names)))], "url string, " + ", ".join(f"{n} int" for n in names))
    got = uf.judge_urls(df, "url").first()
    assert [got[n] for n in names if n != "host"] == [i for i, n in enumerate(names) if n != "host"]
    assert got["host"] == "a.example.com" and got["rule"] == "example.com/en/" and got["verdict"] == "block"
