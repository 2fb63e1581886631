"""Near-duplicates by MinHash with tensored banding, verified on full sets.

1. A document's set: hashes (64 bits) of its distinct word shingles. Rows with equal sets are one class.
2. Two small collections of HALVES half keys each; a half key folds WIDTH minima of the set under different
   permutations, so both collections together take 2 * HALVES * WIDTH minima. Every half key of one collection
   with every one of the other is the key of a table: HALVES * HALVES tables of 2 * WIDTH minima each, which would
   take 2 * HALVES * HALVES * WIDTH minima if each table drew its own. Only classes are put into the tables.
3. Two sets of likeness j meet in a table unless all half keys of one collection differ, so they are missed with
   a chance of less than 2 * (1 - j^WIDTH)^HALVES: `miss_chance`, 2.2 in 100,000 for one pair just at 0.85, 3 in
   10,000,000 at 0.9. A group is lost only if no chain of its links is found: pairs that others connect are verified too.
4. Pairs of a key that few sets share go on if their sizes and bitmap signatures allow a link; a key that more share
   keeps them together. What hangs together is a group, and a group's links are decided in tiles by
   intersecting the sorted sets, as in `jaccard_join`, so no row rests on an estimate.
5. Components of the links, with equal sets joined in; the smallest doc_id of each is kept.

No table, key or group is capped, and the tables' rows grow with the distinct sets: HALVES * HALVES keys each.
Defined results: null text, empty text and texts without words have no set, are linked with nothing and are kept;
texts with fewer words than a shingle are one shingle; rows that repeat a doc_id are one document with all the
links of its rows; a null doc_id has a null component and is kept; an empty table gives an empty one; texts of any
length are shingled whole; columns beyond doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join as jj
from .common import bounded_batches, cut, table

#: Half keys of a collection, minima of a half key.
HALVES, WIDTH = 12, 3
#: Shingles whose minima are taken at a time.
_AT_ONCE = 200_000
_M1 = np.uint64(0x9E3779B97F4A7C15)
_SIZED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("content", pa.binary()), ("bits", pa.binary()), ("halves", pa.binary())])


def miss_chance(likeness: float, halves: int = HALVES, width: int = WIDTH) -> float:
    """The chance that no table holds both of two sets."""
    return 1 - (1 - (1 - likeness**width) ** halves) ** 2


class Sketcher:
    """Non-empty sets -> their half keys: an array of one row a set, the first collection's and then the second's."""

    def __init__(self, halves: int = HALVES, width: int = WIDTH, seed: int = 11):
        self.halves, self.width = halves, width
        # shingle hashes are even over 64 bits, so an odd factor orders them anew
        self.factors = jj._stir((np.arange(1, 2 * halves * width + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _M1) | np.uint64(1)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        if not sets:
            return np.zeros((0, 2 * self.halves), np.uint64)
        x = np.concatenate(sets)
        first = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.zeros((len(sets), 2 * self.halves), np.uint64)
        for k, factor in enumerate(self.factors):
            at = k // self.width
            out[:, at] = jj._stir(out[:, at] * _M1 + np.minimum.reduceat(x * factor, first))
        return out


def table_keys(halves: np.ndarray) -> np.ndarray:
    """Half keys (one row a set) -> the keys of all tables: each of one collection with each of the other."""
    n, m = halves.shape[0], halves.shape[1] // 2
    place = np.arange(m * m, dtype=np.uint64).reshape(m, m)
    return jj._stir(halves[:, :m, None] * _M1 + jj._stir(halves[:, None, m:] + place[None])).reshape(n, m * m)


def _sizer(words: int, sketcher: Sketcher):
    """Size, node, 128-bit digest, signature and half keys of each document's set."""

    def size(batches):
        shingler = jj.Shingler(words)
        for batch in batches:
            rows = [[], [], [], [], []]
            held, held_size = [], 0

            def sketch():
                rows[4].extend(h.tobytes() for h in sketcher(held))
                held.clear()

            empty = []
            for i, x in enumerate(shingler(batch.column("text").to_pylist())):
                rows[0].append(len(x))
                rows[1].append(jj.node_of(x) if len(x) else None)
                rows[2].append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                rows[3].append(jj.signature(x) if len(x) else None)
                if not len(x):
                    empty.append(i)
                    continue
                held.append(x)
                held_size += len(x)
                if held_size >= _AT_ONCE:
                    sketch()
                    held_size = 0
            sketch()
            for i in empty:
                rows[4].insert(i, None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, f.type) for r, f in zip(rows, list(_SIZED)[1:]))], schema=_SIZED)

    return size


def _tables(ranges: int, keys_each: int):
    """Classes (node, halves) become their keys in all tables, by range of keys."""

    def put(batches):
        for pdf in batches:
            nodes = pdf["node"].to_numpy(np.int64)
            step = max(1, jj.THIN // keys_each)
            for a in range(0, len(nodes), step):
                halves = np.frombuffer(b"".join(pdf["halves"].iloc[a : a + step]), np.uint64).reshape(min(step, len(nodes) - a), -1)
                keys = table_keys(halves)
                yield jj.ranged(keys.ravel(), np.repeat(nodes[a : a + step], keys.shape[1]), ranges)

    return put


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, halves: int = HALVES, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); sets are linked at num / den or more.

    For another threshold t choose halves and width by `miss_chance(t, halves, width)`; it is under 1e-3 at 0.8 with 12 and 3.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketcher = Sketcher(halves, width)
    sized = cut(docs.mapInArrow(_sizer(words, sketcher), "doc_id long, n long, node long, content binary, bits binary, halves binary"))

    def candidates(usable, classes, total):
        keys_each = halves * halves
        ranges = max(spark.sparkContext.defaultParallelism, math.ceil(classes.count() * keys_each / jj.RANGE))
        return jj.paired(classes.select("node", "halves").mapInPandas(_tables(ranges, keys_each), jj.RANGED), ranges)

    found = jj.linked(docs, sized, words, num, den, candidates, ("halves",))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 85, 100)

