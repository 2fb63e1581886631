"""The nearest entry of each probe within a cosine of at least t, exact, without scoring all pairs.

Entries are dealt to cells by their nearest pivot, cells to rings by the angle to it, and rings to parts by hash of the id. For
a probe, a pivot and an entry the triangle inequality on angles says angle(probe, entry) >= |angle(probe, pivot) -
angle(entry, pivot)|, so a probe goes only to rings within acos(t) of its own angle. In a part a second bound, the
product of a few leading components (after a rotation onto the sample's main axes) plus that of the rest's norms,
leaves out pairs that can't reach t; what is left is scored.

Pivots and axes are fitted on at most SAMPLE entries; any give exact results. Rings are a row each on the driver
(PIVOTS * RINGS at most). Defined results as in `retrieval.top_k_batch`: cosines are rounded to 6 digits, ties go to the
smaller entry, vectors of one dimension meet, null ids and vectors take no part, zero vectors have cosine 0, which no probe finds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.retrieval import top_k_batch
from lodeworks.operators.shared import bounded_batches, written

SAMPLE, PIVOTS, RINGS, LEAD = 2048, 64, 64, 16
#: Entries of a part, probes of a block, about.
PART, PROBES = 4096, 512
#: Pairs that a task looks at at a time, and the share of them (one in so many) up to which their vectors are gathered.
CELLS, FEW = 500_000, 32
#: Roundings to 6 digits and floating point stay within these.
SLACK, SLACK_ANGLE = 1e-6, 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Fitted:
    """Pivots (far points of the sample first) and axes (its main ones first) for vectors of one dimension."""

    def __init__(self, sample: np.ndarray):
        x = _unit(sample)
        at, far = [0], x @ x[0]
        while len(at) < min(PIVOTS, len(x)) and far.min() < 0.9999:
            at.append(int(far.argmin()))
            far = np.maximum(far, x @ x[at[-1]])
        self.pivots = x[at]
        self.axes = np.linalg.svd(x, full_matrices=True)[2].T[:, : min(LEAD, x.shape[1])]

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.pivots.T, -1, 1))

    def lead(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading components and the norm of the rest."""
        first = unit @ self.axes
        return first, np.sqrt(np.maximum((unit * unit).sum(1) - (first * first).sum(1), 0))


def _rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    rows = df.filter(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return rows


def nearest_within(probes: DataFrame, entries: DataFrame, least: float, exclude_own: bool = False, counts: bool = False) -> DataFrame:
    """probes (probe_id, vec), entries (entry_id, vec) -> probe_id, entry_id, score of each probe's nearest entry with cosine >= least and > 0.

    counts: instead, one row for each meeting of probes with a part: pairs (in it) and scored (of these).
    """
    p, e = _rows(probes, "probe_id", "vec"), _rows(entries, "entry_id", "vec")
    spark = e.sparkSession
    bounded_batches(spark)  # a part is a row of up to some MB
    chosen = e.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = [r["vec"] for r in e.join(F.broadcast(chosen), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect() if len(r["vec"])]
    none = spark.createDataFrame([], "probe_id long, entry_id long, score double")
    if not sample:
        return none
    dim = len(sample[0])
    fitted = spark.sparkContext.broadcast(Fitted(np.array([v for v in sample if len(v) == dim], np.float64)))
    reach = float(np.arccos(max(least - SLACK, 0.0))) + SLACK_ANGLE

    def place(batches):
        for pdf in batches:
            if len(pdf):
                angle = fitted.value.angles(_unit(np.stack(pdf["vec"].tolist())))
                cell = angle.argmin(1)
                yield pdf.assign(cell=cell.astype(np.int32), ring=np.minimum((np.take_along_axis(angle, cell[:, None], 1)[:, 0] / np.pi * RINGS).astype(np.int32), RINGS - 1))

    dealt = written(e.filter(F.size("vec") == dim).mapInPandas(place, "id long, vec array<double>, cell int, ring int"))
    rings = [(r["cell"], r["ring"], -(-r["n"] // PART)) for r in dealt.groupBy("cell", "ring").agg(F.count("*").alias("n")).collect()]
    parts = spark.createDataFrame(rings, "cell int, ring int, parts int")

    def pack(key, pdf):
        unit = _unit(np.stack(pdf["vec"].tolist()))
        lead, rest = fitted.value.lead(unit)
        return pd.DataFrame({"cell": [key[0]], "ring": [key[1]], "part": [key[2]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "mat": [unit.tobytes()], "lead": [lead.tobytes()], "rest": [rest.tobytes()]})

    split = dealt.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = split.groupBy("cell", "ring", "part").applyInPandas(pack, "cell int, ring int, part int, ids binary, mat binary, lead binary, rest binary")

    def reached(batches):
        cells, low, many = (np.array([x[i] for x in rings]) for i in range(3))
        for pdf in (batch.iloc[a : a + 256] for batch in batches for a in range(0, len(batch), 256)):
            unit = _unit(np.stack(pdf["vec"].tolist()))
            angle = fitted.value.angles(unit)[:, cells]
            ok = (angle + reach >= low * np.pi / RINGS - SLACK_ANGLE) & (angle - reach <= (low + 1) * np.pi / RINGS + SLACK_ANGLE) & (unit != 0).any(1)[:, None]
            q, r = np.nonzero(ok)
            each = many[r]
            q, r = np.repeat(q, each), np.repeat(r, each)
            part = np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each)
            ids = pdf["id"].to_numpy(np.int64)
            for a in range(0, len(q), 20_000):
                b = slice(a, a + 20_000)
                yield pd.DataFrame({"cell": cells[r[b]].astype(np.int32), "ring": low[r[b]].astype(np.int32), "part": part[b].astype(np.int32), "probe_id": ids[q[b]], "unit": [unit[i].tobytes() for i in q[b]]})

    sent = p.filter(F.size("vec") == dim).mapInPandas(reached, "cell int, ring int, part int, probe_id long, unit binary")
    waves = max(1, -(-probes.count() // PROBES))
    packed = sent.withColumn("wave", F.pmod(F.xxhash64("probe_id"), F.lit(waves))).groupBy("cell", "ring", "part", "wave").agg(F.collect_list(F.struct("probe_id", "unit")).alias("asked"))

    def score(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                mat, lead, rest = np.frombuffer(r.mat).reshape(len(ids), dim), np.frombuffer(r.lead).reshape(len(ids), -1), np.frombuffer(r.rest)
                qids = np.array([a["probe_id"] for a in r.asked], np.int64)
                unit = np.stack([np.frombuffer(a["unit"]) for a in r.asked])
                qlead, qrest = fitted.value.lead(unit)
                step = max(1, CELLS // max(1, len(ids)))
                for a in range(0, len(qids), step):
                    b = slice(a, a + step)
                    may = qlead[b] @ lead.T + qrest[b, None] * rest[None] >= max(least, 0) - SLACK - 1e-9
                    if exclude_own:
                        may &= qids[b, None] != ids[None]
                    q, x = np.nonzero(may)
                    if counts:
                        yield pd.DataFrame({"pairs": [may.size], "scored": [len(q)]})
                        continue
                    # few pairs are gathered; of many, which a loose threshold leaves, a product of matrices is smaller
                    s = np.einsum("ij,ij->i", unit[b][q], mat[x]) if len(q) * FEW <= may.size else (unit[b] @ mat.T)[q, x]
                    s = np.round(s, 6) + 0.0
                    good = (s >= least) & (s > 0)
                    q, x, s = q[good], x[good], s[good]
                    order = np.lexsort((ids[x], -s, q))
                    first = order[np.unique(q[order], return_index=True)[1]]
                    yield pd.DataFrame({"probe_id": qids[b][q[first]], "entry_id": ids[x[first]], "score": s[first]})

    met = blocks.join(packed, ["cell", "ring", "part"])
    if counts:
        return met.mapInPandas(score, "pairs long, scored long").agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))
    found = met.mapInPandas(score, "probe_id long, entry_id long, score double")
    # vectors of other dimensions than the index's meet plainly
    other = top_k_batch(probes.filter(F.size("vec") != dim).select(F.col("probe_id").alias("query_id"), F.col("vec").alias("query_vec")), entries.filter(F.size("vec") != dim).select(F.col("entry_id").alias("vec_id"), F.col("vec").alias("embedding")), 1, exclude_own)
    found = found.unionByName(other.filter((F.col("score") >= least) & (F.col("score") > 0)).select(F.col("query_id").alias("probe_id"), F.col("vec_id").alias("entry_id"), "score"))
    best = found.groupBy("probe_id").agg(F.max(F.struct("score", (-F.col("entry_id")).alias("e"))).alias("b"))
    return best.select("probe_id", (-F.col("b.e")).alias("entry_id"), F.col("b.score").alias("score"))
