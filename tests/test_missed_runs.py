import bisect
import datetime as dt
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from lodeworks.operators.asof import as_of
from lodeworks.sources import catalog


def test_as_of_equals_a_search_in_sorted_lists(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(minutes=rng.randint(0, 6000))
    left = [(i, rng.choice("aaaab"), at()) for i in range(800)] + [(900, "c", at()), (901, "a", None)]
    right = [(rng.choice("ab"), at(), i) for i in range(300)] + [("a", start, 1000), ("a", start, 999), ("b", None, 5)]
    found = as_of(spark.createDataFrame(left, "id int, k string, ts timestamp_ntz"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v int"), ["k"], "ts", "v", 3600)
    lists = {k: sorted((t, v) for kk, t, v in right if kk == k and t) for k in "abc"}

    def want(k, t):
        i = bisect.bisect_right(lists[k], (t, 10**9)) if t else 0
        return lists[k][i - 1][1] if i else None

    assert {r["id"]: r["v"] for r in found.collect()} == {i: want(k, t) for i, k, t in left}
    assert found.columns == ["id", "k", "ts", "v"]


def fires(job, zone, a, b):
    """Fire times of a job by the wall clock between two UTC times, in UTC."""
    hour, out = {"daily": 2, "weekly": 3, "monthly": 4}[job], []
    day = a.date() - dt.timedelta(days=40)
    while day <= b.date() + dt.timedelta(days=1):
        if job == "daily" or (job == "weekly" and day.weekday() == 0) or (job == "monthly" and day.day == 1):
            t = dt.datetime(day.year, day.month, day.day, hour, tzinfo=ZoneInfo(zone)).astimezone(dt.UTC).replace(tzinfo=None)
            if a < t <= b:
                out.append(t)
        day += dt.timedelta(days=1)
    return out


def test_fire_times_grace_and_clock_changes(spark):
    rng = random.Random(3)
    for zone in ("Europe/Istanbul", "Europe/Berlin", "America/New_York"):
        start = dt.datetime(2024, 3, 1)
        ticks = [(i, start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 45))) for i in range(250)]
        ticks += [(1000, dt.datetime(2024, 4, 1, 2, 30)), (1001, dt.datetime(2024, 4, 1, 0, 30)), (1002, dt.datetime(2024, 4, 1, 9, 0)), (1003, dt.datetime(2024, 3, 31, 0, 59)), (1004, dt.datetime(2024, 3, 31, 1, 1))]
        runs = [(job, start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 45))) for job in ("daily", "weekly") for _ in range(12)]
        got = catalog.missed_runs(spark.createDataFrame(ticks, "id int, ts timestamp_ntz"), spark.createDataFrame(runs, "frequency string, ts timestamp_ntz"), zone).collect()
        assert len(got) == 3 * len(ticks)
        for r in got:
            last = max((t for j, t in runs if j == r["frequency"] and t <= r["ts"]), default=None)
            assert r["last_run"] == last
            every = fires(r["frequency"], zone, dt.datetime(2024, 1, 1), r["ts"])
            assert r["fire"] == every[-1], (zone, r)
            missed = 1 if last is None else len([t for t in every if t > last])
            late = (r["ts"] - every[-1]).total_seconds()
            assert (r["missed"], r["late_s"]) == (missed, late)
            assert r["run"] == (missed > 0 and late <= (7200 if r["frequency"] == "monthly" else 3600))


def test_coalesced_once_per_tick_and_never_without_a_miss(spark):
    ticks = spark.createDataFrame([(1, dt.datetime(2024, 5, 10, 23, 30))], "id int, ts timestamp_ntz")  # half an hour after 02:00 in Istanbul
    late = catalog.missed_runs(ticks, spark.createDataFrame([("daily", dt.datetime(2024, 5, 6, 23, 0))], "frequency string, ts timestamp_ntz"))
    row = late.filter("frequency = 'daily'").first()
    assert (row["missed"], row["late_s"], row["run"]) == (4, 1800, True)
    done = catalog.missed_runs(ticks, spark.createDataFrame([("daily", dt.datetime(2024, 5, 10, 23, 1))], "frequency string, ts timestamp_ntz"))
    assert done.filter(F.col("run") & (F.col("frequency") == "daily")).isEmpty()
