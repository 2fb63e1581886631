"""Ranked lexical search: WAND over posting blocks of variable length, per shard of documents, exact.

1. `build_postings`: tasks read documents once and deal them to shards of at most SHARD_DOCS documents and about
   SHARD_TERMS terms. In a shard documents are numbered by length, then id, so that neighbours weigh a term alike.
   Each term of a shard gets a posting list: numbers and frequencies, in as few bytes as they need.
2. Corpus statistics (documents, terms, documents of each term) are sums over all shards.
3. `choose_blocks`: a list is cut where the error of its bounds is least: dynamic programming over all cuts into blocks of
   at most LONGEST postings minimises the sum of (block maximum - impact) plus BLOCK_COST a block. Lists of like
   length are solved side by side.
4. `search_shard`: the sum of the block maxima that cover a document bounds its score. Only documents whose bound reaches
   the item's k-th score live on, and a block without a live document is skipped. GROUP terms at a time, the dearest
   first, blocks that must be read turn bounds into scores, which raises the k-th score and leaves fewer alive. A task
   carries each item's k-th score from shard to shard.
5. Each task hands on k rows an item at most, and a window ranks them.

Items go in blocks of about ITEM_TERMS terms; a block of items meets every shard, so neither side is broadcast or
collected. All arithmetic but a term's weight is in 64-bit integers.

Defined results: terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; null and empty
texts have none; rows without doc_id or item_id take no part; rows that repeat a doc_id are documents of their
own; rows that repeat an item_id are one item with all their terms; documents of score 0 are not found; ties go to the smaller doc_id;
an empty table gives an empty one; texts of any length are read whole; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table

#: Documents and terms (repeats included) of a shard, about; a shard ends with the document that passes either.
SHARD_DOCS, SHARD_TERMS = 16_384, 8_000_000
#: Postings of a block at most; what one more block has to save in bounds, in impact.
LONGEST, BLOCK_COST = 64, 250_000
#: Distinct (item, term) rows of a block of items, about.
ITEM_TERMS = 200_000
#: Terms asked for up to which the postings of no other terms are written.
ASKED_TERMS = 500_000
#: Terms of an item after which documents that can't be among its k best are left.
GROUP = 6

_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_POSTINGS = pa.schema([("shard", pa.string()), ("kind", pa.int32()), ("term", pa.binary()), ("df", pa.int64()), ("terms", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_POSTINGS_DDL = "shard string, kind int, term binary, df long, terms long, a binary, b binary"
_DOCS, _ITEMS, _LIST = 0, 1, 2


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _thin(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest one needs."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64).tobytes()


def _wide(b: bytes, count: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{len(b) // count}").astype(np.int64)


class _Shard:
    """Documents of one shard while it is filled."""

    def __init__(self, name: str):
        self.name, self.ids, self.sizes, self.lists, self.total = name, [], [], {}, 0

    def add(self, doc_id: int, text: bytes, asked) -> None:
        found = terms_of(text)
        if not found:
            return
        at = len(self.ids)
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.total += len(found)
        counts = Counter(found)
        for t in counts if asked is None else counts.keys() & asked:
            held = self.lists.get(t)
            if held is None:
                held = self.lists[t] = ([], [])
            held[0].append(at)
            held[1].append(counts[t])

    def rows(self) -> pa.RecordBatch:
        ids, sizes = np.array(self.ids, np.int64), np.array(self.sizes, np.int64)
        order = np.lexsort((ids, sizes))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        out = [(self.name, _DOCS, None, len(ids), self.total, ids[order].tobytes(), sizes[order].tobytes())]
        for t, (docs, tfs) in self.lists.items():
            mine = number[docs]
            by = np.argsort(mine)
            out.append((self.name, _LIST, t, len(mine), None, _thin(mine[by]), _thin(np.array(tfs, np.int64)[by])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _POSTINGS)], schema=_POSTINGS)


def _indexer(asked):
    """Rows doc_id, text (bytes) become shards: a row of ids and lengths, and a row for each term's list."""

    def index(batches):
        wanted = asked.value if asked is not None else None
        task = TaskContext.get()
        name = lambda k: f"{task.partitionId() if task else 0}-{k}"  # noqa: E731 - the same in a task that is run again
        shard, n = _Shard(name(0)), 1
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.add(doc_id, text, wanted)
                if len(shard.ids) >= SHARD_DOCS or shard.total >= SHARD_TERMS:
                    yield shard.rows()
                    shard, n = _Shard(name(n)), n + 1
        if shard.ids:
            yield shard.rows()

    return index


def item_terms(items: DataFrame) -> DataFrame:
    """items: item_id, text -> item_id, term (bytes), times."""

    def count(batches):
        for batch in batches:
            rows = [(i, t, c) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, c in Counter(terms_of(text)).items()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["item_id", "term", "times"])

    slim = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    each = slim.mapInArrow(count, "item_id long, term binary, times long")
    return each.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def build_postings(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text. Posting lists by shard as a table of the shared folder; with `asked` (term), of these terms
    alone if they are at most ASKED_TERMS. Statistics cover all documents and terms."""
    spark = docs.sparkSession
    bounded_batches(spark)
    only = None
    if asked is not None:
        found = asked.select("term").distinct().limit(ASKED_TERMS + 1).collect()
        if len(found) <= ASKED_TERMS:
            only = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in found))
    slim = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return cut(slim.mapInArrow(_indexer(only), _POSTINGS_DDL))


def choose_blocks(lists: list[np.ndarray], block_cost: int = BLOCK_COST, longest: int = LONGEST) -> list[np.ndarray]:
    """For each list of impacts the ends of its blocks, with the least sum of (length * maximum + block_cost) over blocks.

    The sum of impacts is the same for all cuts, so this is the least error of the bounds.
    """
    ends: list = [None] * len(lists)
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    at = 0
    while at < len(order):
        least = len(lists[order[at]])
        upto = at
        while upto < len(order) and len(lists[order[upto]]) <= least + least // 4 and (upto - at + 1) * len(lists[order[upto]]) <= 1_000_000:
            upto += 1
        some = order[at : max(upto, at + 1)]
        for i, e in zip(some, _cut_alike([lists[i] for i in some], block_cost, longest)):
            ends[i] = e
        at += len(some)
    return ends


def _cut_alike(lists: list[np.ndarray], block_cost: int, longest: int) -> list[np.ndarray]:
    size = np.array([len(x) for x in lists])
    top, many = int(size.max()), len(lists)
    s = np.zeros((top, many), np.int64)
    for k, x in enumerate(lists):
        s[: len(x), k] = x
    best, came = np.zeros((top + 1, many), np.int64), np.zeros((top + 1, many), np.int32)
    largest = np.zeros((top, many), np.int64)  # of the postings from a start up to the present one
    for i in range(1, top + 1):
        low = max(0, i - longest)
        w = largest[low:i]
        np.maximum(w, s[i - 1], out=w)
        cost = w * np.arange(i - low, 0, -1)[:, None]
        cost += best[low:i]
        k = cost.argmin(0)
        came[i] = k + low
        best[i] = cost[k, np.arange(many)] + block_cost
    out = []
    for k in range(many):
        at, e = int(size[k]), []
        while at:
            e.append(at)
            at = int(came[at, k])
        out.append(np.array(e[::-1], np.int64))
    return out


def impacts(tf: np.ndarray, sizes: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term weighs in a document, before the term's own weight."""
    m = 75 + (25 * sizes * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Postings:
    """One term's list in a shard, in blocks."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray, ends: np.ndarray):
        self.docs, self.impact = docs, impact
        starts = np.append(0, ends[:-1])
        self.first, self.beyond, self.length = docs[starts], docs[ends - 1] + 1, ends - starts
        self.most = np.maximum.reduceat(impact, starts)


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_shard(asked: list[tuple[Postings, int]], ids: np.ndarray, k: int, scores: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """asked: lists of an item's terms and their weights. The k best of (scores, found) and this shard, and how many blocks were read."""
    asked = sorted(((p, w) for p, w in asked if w > 0), key=lambda x: -int(x[0].most.max()) * x[1])
    groups = [asked[g : g + GROUP] for g in range(0, len(asked), GROUP)]
    rest = [np.zeros(len(ids))]  # bounds of each document by the terms from a group on, built from the last group
    for group in reversed(groups):
        at = np.concatenate([x for p, _ in group for x in (p.first, p.beyond)])
        step = np.concatenate([x for p, w in group for x in (p.most * float(w), p.most * -float(w))])
        rest.append(rest[-1] + np.cumsum(np.bincount(at, step, len(ids) + 1)[: len(ids)]))
    rest.reverse()
    slack = 1e-9 * rest[0].max(initial=0)
    floor = int(scores[k - 1]) if len(scores) >= k else 1
    live, sums, read = rest[0] + slack >= floor, np.zeros(len(ids), np.int64), 0
    for group, left in zip(groups, rest[1:]):
        before = np.append(0, np.cumsum(live))
        for p, w in group:
            need = before[p.beyond] > before[p.first]
            read += int(need.sum())
            some = np.repeat(need, p.length)
            sums[p.docs[some]] += p.impact[some] * w
        known = sums[live]
        if len(known) > k:
            floor = max(floor, int(np.partition(known, -k)[-k]))
        live &= sums + left + slack >= floor
        if not live.any():
            return scores, found, read
    good = np.nonzero(live & (sums >= floor))[0]
    return *_better(np.concatenate([scores, sums[good]]), np.concatenate([found, ids[good]]), k), read


def _searcher(k: int, docs: int, terms: int):
    """Rows sorted by block of items, shard and kind become the k best documents of each item in this task."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        best: dict = {}  # item -> scores, ids
        asked: dict = {}  # item -> [(term, weight)]
        key, head, lists = None, None, []

        def shard():
            if head is None or not lists or not asked:
                return
            ids, sizes = (np.frombuffer(x, np.int64) for x in head)
            rows = []
            for _, df, a, b in lists:
                number = _wide(a, df)
                rows.append((number, impacts(_wide(b, df), sizes[number], docs, terms)))
            held = {t: Postings(*r, e) for (t, *_), r, e in zip(lists, rows, choose_blocks([r[1] for r in rows]))}
            none = np.zeros(0, np.int64)
            for item, wanted in asked.items():
                mine = [(held[t], w) for t, w in wanted if t in held]
                if mine:
                    best[item] = search_shard(mine, ids, k, *best.get(item, (none, none)))[:2]

        def out():
            rows = [(i, d, s) for i, (scores, found) in best.items() for s, d in zip(scores.tolist(), found.tolist())]
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for batch in batches:
            for block, name, kind, term, df, a, b, its in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (block, name) != key:
                    shard()
                    if key is not None and block != key[0]:
                        yield out()
                        best = {}
                        asked = {}
                    key, head, lists = (block, name), None, []
                if kind == _DOCS:
                    head = (a, b)
                elif kind == _ITEMS:
                    if not asked:
                        for x in its:
                            asked.setdefault(x["item_id"], []).append((x["term"], x["weight"]))
                else:
                    lists.append((term, df, a, b))
        shard()
        if best:
            yield out()

    return search


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """items: item_id, text; docs: doc_id, text -> item_id, rank, doc_id, score of each item's k best documents."""
    spark = docs.sparkSession
    wanted = cut(item_terms(items))
    postings = build_postings(docs, wanted)
    return search(wanted, postings, k)


def search(wanted: DataFrame, postings: DataFrame, k: int = 20) -> DataFrame:
    """wanted: item_terms(...) and postings: build_postings(...), which holds all of their terms, as tables."""
    spark = postings.sparkSession
    docs, terms, shards = postings.filter(F.col("kind") == _DOCS).agg(F.sum("df"), F.sum("terms"), F.count("*")).first()
    if not terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = max(1, math.ceil(wanted.count() / ITEM_TERMS))
    df = postings.filter(F.col("kind") == _LIST).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(df, "term").select("item_id", "term", (weight * F.col("times")).alias("weight"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"))
    weighed = cut(weighed)
    asked = weighed.groupBy("block").agg(F.collect_list(F.struct("item_id", "term", "weight")).alias("items"))
    none = F.lit(None).cast("binary")
    heads = postings.filter(F.col("kind") == _DOCS).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = ["block", "shard", "kind", "term", "df", "a", "b", "items"]
    nothing = F.lit(None).cast("array<struct<item_id:long,term:binary,weight:long>>")
    questions = heads.select("block", "shard").join(asked, "block").select("block", "shard", F.lit(_ITEMS).alias("kind"), none.alias("term"), F.lit(None).cast("long").alias("df"), none.alias("a"), none.alias("b"), "items")
    lists = postings.filter(F.col("kind") == _LIST).join(weighed.select("term", "block").distinct(), "term").withColumn("items", nothing).select(*names)
    rows = heads.withColumn("items", nothing).select(*names).unionByName(questions).unionByName(lists)
    tasks = max(1, min(shards * blocks, max(spark.sparkContext.defaultParallelism, shards * blocks // 4)))
    dealt = rows.repartition(tasks, "block", "shard").sortWithinPartitions("block", "shard", "kind")
    found = dealt.mapInArrow(_searcher(k, docs, terms), "item_id long, doc_id long, score long")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT r, doc_id, {_TERMS} AS term FROM d),
tf AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * (SELECT docs FROM c) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (r), c GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 20"""
