"""URL filters: a Bloom filter cascade over the corpus's complete key universe.

A rule (action, host, path) is the key host + path. A url's candidate keys are those a rule could
have: its host's suffixes with as many labels as some rule's host, each with the prefixes of its path
as long as some rule's path. All keys of the corpus are the universe. Level 1 of a cascade encodes the
listed keys; each further level encodes those keys of the other side that pass the level before, until
none does. So membership is exact for every key of the universe, without a join: the filters are
literals of the plan.

Sizes: level 1 has a false positive rate of sqrt(1/2) * listed / universe, so about listed keys pass
by mistake, and each further one of LATER_RATE: together O(listed * log(universe / listed)) bits, whatever the
corpus holds. Only these filters come to the driver.

Only DataFrame functions. Defined results: a url that is null or lacks `://` has host and path empty;
with no fitting rule, the rule is null and the cascade says allow; repeated rows give repeated results; an
empty table gives an empty one; input columns host, path, rule and verdict give way to the new ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bits in a byte of a filter: seven, so that each byte is one ASCII character.
_BITS = 7
#: False positive rate of each level after the first.
LATER_RATE = 1 / 16


@dataclass(frozen=True)
class Level:
    bits: bytes
    size: int
    hashes: int
    seed: int


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, rules) -> Column:
    """Array of (length, host length, key) of every key a rule could have for this url."""
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    # Of a.b.c, the suffix of n labels is what substring_index takes from the right.
    suffixes = F.array(*(F.when(F.size(F.split(host, r"\.")) >= n, F.substring_index(host, ".", -n)) for n in labels))
    prefixes = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct((F.length(h) + F.length(p)).alias("n"), F.length(h).alias("h"), F.concat(h, p).alias("key")))))
    return F.filter(keys, lambda k: k["key"].isNotNull())


def _positions(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
    """Bits of a key. Each level has its own seed, so that what collides in one needn't in the next."""
    a, b = (F.pmod(F.xxhash64(F.lit(s), key), F.lit(size)) for s in (2 * seed, 2 * seed + 1))
    return [F.pmod(a + b * j, F.lit(size)) for j in range(hashes)]


def _passes(key: Column, level: Level) -> Column:
    bits, found = F.lit(level.bits), F.lit(True)
    for at in _positions(key, level.size, level.hashes, level.seed):
        byte = F.ascii(F.substring(bits, (F.floor(at / _BITS) + 1).cast("int"), F.lit(1)).cast("string"))
        found = found & (F.bit_get(byte, (at % _BITS).cast("int")) == 1)
    return found


def _encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of a column `key` of n rows."""
    size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(-math.log2(rate)))
    at = F.explode(F.array(*_positions(F.col("key"), size, hashes, seed)))
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / _BITS).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(at % {_BITS} as int))")).alias("set")).collect()
    bits = bytearray(-(-size // _BITS))
    for r in rows:
        bits[r["byte"]] = r["set"]
    return Level(bytes(bits), size, hashes, seed)


def build_cascade(listed: list[str], universe: DataFrame) -> list[Level]:
    """Levels that tell the listed keys from all others of universe (a column `key`, repeats allowed)."""
    if not listed:
        return []
    mine = universe.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, sorted(set(listed))))).alias("key"))
    n = len(set(listed))
    others = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    levels = [_encode(mine, n, min(0.5, math.sqrt(0.5) * n / others), 0)]
    # What passes level 1: about as many keys as are listed. `own` tells the sides apart, by grouping.
    tagged = universe.filter(_passes(F.col("key"), levels[0])).select("key", F.lit(0).alias("own")).unionByName(mine.withColumn("own", F.lit(1)))
    left = cut(tagged.groupBy("key").agg(F.max("own").alias("own")))
    side = 0
    while wrong := left.filter(F.col("own") == side).count():
        levels.append(_encode(left.filter(F.col("own") == side), wrong, LATER_RATE, len(levels)))
        # Undecided are the keys just encoded and those of the other side that pass.
        left = cut(left.filter(_passes(F.col("key"), levels[-1])))
        side = 1 - side
    return levels


def listed_in(key: Column, levels: list[Level]) -> Column:
    """Exact membership, for keys of the universe: the first level that a key fails tells its side."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(_passes(key, levels[k]), out).otherwise(F.lit(k % 2 == 1))
    return out


def judge_urls(pages: DataFrame, url: str, rules=RULES) -> DataFrame:
    """pages with host, path, rule (longest fitting, longer host first among equals; null if none) and verdict."""
    held = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # columns of pages travel under names of our own, so none can clash with what is made here
    kept = [F.col(c).alias(f"in{i}") for i, c in enumerate(held)]
    df = pages.select(*kept, F.col(url).alias("_url"))
    df = df.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url"))).drop("_url")
    df = df.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = df.select(F.explode("_keys").alias("k")).select("k.key")
    cascades = {action: build_cascade([h + p for a, h, p in rules if a == action], universe) for action in ("allow", "block")}
    judged = F.transform("_keys", lambda k: F.struct(k["n"].alias("n"), k["h"].alias("h"), k["key"].alias("key"), listed_in(k["key"], cascades["allow"]).alias("allow"), listed_in(k["key"], cascades["block"]).alias("block")))
    df = df.withColumn("_best", F.array_max(F.filter(judged, lambda k: k["allow"] | k["block"])))
    return df.select(*(F.col(f"in{i}").alias(c) for i, c in enumerate(held)), "host", "path", F.col("_best.key").alias("rule"), F.when(F.col("_best.block"), "block").otherwise("allow").alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
SQL = rf"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(action, h, p) AS (VALUES {_VALUES})
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
   ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
  coalesce((SELECT action FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
   ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""
