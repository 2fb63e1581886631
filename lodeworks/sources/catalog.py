"""The source catalogue, due targets and delta scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.asof import as_of, utc, wall

SCHEMA = "key string, label string, url string, crawl_type string, frequency string, priority int, js_wait_ms int, extra map<string,string>"
# Kinds of targets, frequencies.
CRAWL_TYPES = ["api_json", "api_staff", "api_sss", "html_static", "html_js"]
FREQUENCIES = ["daily", "weekly", "monthly", "once"]
#: frequency, day of week (1 Monday) or of month, hour; in the zone.
SCHEDULE = [("daily", None, None, 2), ("weekly", 1, None, 3), ("monthly", None, 1, 4)]
ZONE = "Europe/Istanbul"


def catalogue(spark: SparkSession, targets: list[dict]) -> DataFrame:
    rows = [(t["key"], t.get("label", t["key"]), t["url"], t["crawl_type"], t["frequency"], t.get("priority", 1), t.get("js_wait_ms", 1000), t.get("extra", {})) for t in targets]
    return spark.createDataFrame(rows, SCHEMA)


def selected(targets: DataFrame, keys: DataFrame | None = None, frequency: str | None = None) -> DataFrame:
    """Targets of a frequency, and of a table of keys."""
    out = targets if frequency is None else targets.filter(F.col("frequency") == frequency)
    return out if keys is None else out.join(keys.select("key").distinct(), "key", "left_semi")


def mode_targets(targets: DataFrame, mode: str) -> DataFrame:
    """Targets of a run mode: full takes all, the others those of their frequency."""
    if mode != "full" and mode not in FREQUENCIES:
        raise ValueError(f"unknown mode {mode}")
    return selected(targets, frequency=None if mode == "full" else mode)


def due(ticks: DataFrame, ts: str = "ts") -> DataFrame:
    """ticks with a row for each frequency that is due in the hour of ts (UTC)."""
    at = F.from_utc_timestamp(F.col(ts).cast("timestamp"), ZONE)
    hits = [F.when((F.hour(at) == h) & (F.lit(True) if dow is None else F.weekday(at) + 1 == dow) & (F.lit(True) if dom is None else F.dayofmonth(at) == dom), name) for name, dow, dom, h in SCHEDULE]
    return ticks.withColumn("frequency", F.explode(F.array_compact(F.array(*hits))))


def max_watermark(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.coalesce(F.max(key), F.lit(0).cast("long")).alias("max_id"))


def delta(rows: DataFrame, key: str, known: int) -> tuple[DataFrame, DataFrame]:
    """(new rows, quarantined rows without a key)."""
    return rows.filter(F.col(key) > known), rows.filter(F.col(key).isNull())


def page_ranges(rows: DataFrame, key: str, per_page: int) -> DataFrame:
    return rows.groupBy(F.floor(F.col(key) / per_page).cast("long").alias("page")).agg(F.min(key).alias("min_id"), F.max(key).alias("max_id"), F.count("*").alias("n"))


# Seconds after a fire time within which a missed run still starts.
GRACE = {"daily": 3600, "weekly": 3600, "monthly": 7200}


def _fire(job: str, dow: int | None, dom: int | None, hour: int, at: Column) -> tuple[Column, Column]:
    """The last fire time of a job not after a wall time, and its number (days, weeks or months), both by the wall clock."""
    day = F.to_date(at - F.expr(f"INTERVAL {hour} HOURS"))
    if dow is not None:
        day = F.date_sub(F.next_day(day, ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"][dow - 1]), 7)
        number = F.floor(F.date_diff(day, F.lit("1970-01-01").cast("date")) / 7)
    elif dom is not None:
        first = F.date_add(F.trunc(day, "month"), dom - 1)
        day = F.when(first <= day, first).otherwise(F.date_add(F.trunc(F.add_months(day, -1), "month"), dom - 1))
        number = F.year(day) * 12 + F.month(day)
    else:
        number = F.date_diff(day, F.lit("1970-01-01").cast("date"))
    return day.cast("timestamp_ntz") + F.expr(f"INTERVAL {hour} HOURS"), number.cast("long")


def missed_runs(ticks: DataFrame, runs: DataFrame, zone: str = ZONE) -> DataFrame:
    """What is due at each tick. ticks: any columns and ts; runs, the run log: frequency, ts (UTC, timestamp_ntz).

    A row a tick and frequency of SCHEDULE: last_run (as of the tick; null: never), fire (UTC, the last fire time not after
    the tick), missed (fire times since the last run; for one that never ran, 1), late_s, and run: whether the missed
    ones, as one, still start, which is within GRACE of the last of them. Fire times keep to the zone's wall clock, so a
    change of the clock shifts them in UTC; one that the clock leaps over is at the time it leaps to.
    """
    jobs = F.explode(F.array(*(F.lit(x[0]) for x in SCHEDULE)))
    log = runs.select("frequency", F.col("ts").cast("timestamp_ntz").alias("ts")).withColumn("last_run", F.col("ts"))
    due_at = as_of(ticks.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("frequency", jobs), log, ["frequency"], "ts", "last_run")
    fire, fired, ran = (F.lit(None) for _ in range(3))
    for job, dow, dom, hour in SCHEDULE:
        at, number = _fire(job, dow, dom, hour, wall(F.col("ts"), zone))
        _, before = _fire(job, dow, dom, hour, wall(F.col("last_run"), zone))
        mine = F.col("frequency") == job
        fire, fired, ran = F.when(mine, at).otherwise(fire), F.when(mine, number).otherwise(fired), F.when(mine, before).otherwise(ran)
    out = due_at.withColumns({"fire": utc(fire, zone), "missed": F.when(F.col("last_run").isNull(), F.lit(1)).otherwise(fired - ran).cast("long")})
    late = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("fire").cast("timestamp"))
    grace = F.create_map(*(F.lit(x) for kv in GRACE.items() for x in kv))[F.col("frequency")]
    return out.withColumn("late_s", late).withColumn("run", (F.col("missed") > 0) & (F.col("late_s") <= grace))
