"""Every registered query under Spark's own defaults, not those of get_session, against its SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodeworks.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    changed = {"spark.sql.mapKeyDedupPolicy": "EXCEPTION"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plainly(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return {k: plainly(x) for k, x in v.items()}
    return [plainly(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(plain, con, name):
    found = QUERIES[name](plain, SF)
    rows = found.collect()
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name])
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(found.columns)
        key = lambda r: repr(plainly(r))
        assert sorted(map(key, (tuple(r[c] for c in cols) for r in rows))) == sorted(map(key, want.fetchall()))
