"""Times within a second of a limit, held against the queries' SQL."""

import duckdb
import pytest

from lodeworks.plans.catalogue import ORACLE_SQL, QUERIES

#: Puts that run out at 12:00:00.6, :00.5, :00.4 and :01.5 by the clock, for both lives; the nearest whole second counts.
PUTS = ["11:30:00.6", "11:30:00.5", "11:30:00.4", "11:30:01.5", "11:29:59.7", "11:30:00"]


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("near"))
    rows = [(2 * i + 1, f"2024-01-15 {t}", i) for i, t in enumerate(PUTS)]
    rows += [(2 * i + 100, f"2024-01-14 {t.replace('11:30', '12:00').replace('11:29', '11:59')}", i) for i, t in enumerate(PUTS)]
    # a write 7200.2 s later, but 7201 whole seconds; one 7200.8 s later, but 7200
    rows += [(200, "2024-01-20 00:00:00.4", 50), (201, "2024-01-20 02:00:00.6", 50), (202, "2024-01-21 00:00:00.6", 51), (203, "2024-01-21 02:00:01.4", 51)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "ts::timestamp_ntz AS ts", "user_id").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return folder, con


def equal(spark, near, name):
    want = near[1].execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    want = want.fetchall()
    assert sorted(tuple(r) for r in QUERIES[name](spark, near[0]).select(*cols).collect()) == sorted(want)
    return want


def test_cache_expiry(spark, near):
    assert len(equal(spark, near, "cache_expiry")) == 4


def test_cache_stats(spark, near):
    assert {r[1] for r in equal(spark, near, "cache_stats")} == {2}


def test_stats(spark, near):
    assert len(equal(spark, near, "stats")) == 1


def test_sessionize_ttl(spark, near):
    assert {(200, 50, 1), (201, 50, 2), (202, 51, 1), (203, 51, 1)} <= set(equal(spark, near, "sessionize_ttl"))
