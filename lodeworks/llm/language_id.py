"""Language identification by averaged hashed subword embeddings and a linear softmax.

Features are character n-grams (2 and 3 letters, with and without a word's end, and words of one letter)
of the lower-cased letters of the whole text, so that every text with a letter has one, hashed into
BUCKETS rows of an embedding; a text's vector is their mean. Embedding and softmax are trained together
by stochastic gradient descent in numpy, on chunks of the texts, so that short texts are known too. A
temperature fitted on chunks kept out of training calibrates the score, and texts whose score is under
the threshold found there count as rejected.

For prediction, embedding times softmax is one table of BUCKETS x languages: no text is truncated, and
a text's time is linear in its length, in pieces of about PIECE characters that end where a word does.

Training reads at most SAMPLE labelled documents, those with the smallest hashes of doc_id outside the
held-out fold, and their whole texts, cut into chunks of CHUNK_WORDS words in turn. Only ids are ordered;
the texts of those chosen come to the driver. Of rows that repeat a doc_id the smallest text trains. With
fewer than 50 documents none is kept out, and the temperature is fitted on the training chunks.

Defined results: a text that is null or has no letter is `und` with score 0 and is rejected; without
labelled rows all are; repeated rows repeat results; of equally likely languages the first by name is
predicted; a null doc_id isn't held out; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

SAMPLE, BUCKETS, DIM, SIZES = 2000, 1 << 15, 12, (2, 3)
PIECE = 500_000
CHUNK_WORDS, EPOCHS, RATE = (3, 10, 40, 80), 3, 0.5
KEPT_OUT, QUANTILE = 5, 0.005

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for all that are no letters, and a 0 at each end."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.where(_is_letter()[x], x, 0), [0]]).astype(np.uint64)


def pieces(text: str, most: int = PIECE):
    """Ranges of about `most` characters that cover the text; none ends inside a run of letters."""
    a = 0
    while a < len(text):
        b = min(a + most, len(text))
        while b < len(text) and text[b].isalpha() and text[b - 1].isalpha():
            b += 1
        yield a, b
        a = b


def grams(x: np.ndarray):
    """Positions and buckets of all n-grams without a word's end inside."""
    for n in SIZES:
        m = n + 1 if n > 1 else 1
        for size in {n, m}:
            if len(x) < size or (size == 1 and n > 1):
                continue
            h, inner = np.zeros(len(x) - size + 1, np.uint64), np.ones(len(x) - size + 1, bool)
            for k in range(size):
                part = x[k : len(x) - size + 1 + k]
                h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < k < size - 1 or size == 1:
                    inner &= part != 0
            if size == n and n > 1:
                inner &= (x[: len(h)] != 0) & (x[size - 1 :] != 0)
            elif size > 1:
                ends = np.logical_or if size == 3 else np.logical_xor  # a word of one letter has both its ends
                inner &= ends(x[: len(h)] == 0, x[size - 1 :] == 0)
            at = np.nonzero(inner)[0]
            yield at, (h[at] >> np.uint64(40)) % np.uint64(BUCKETS)


class LanguageModel:
    def __init__(self, names: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.names, self.logits, self.bias, self.temperature, self.least = names, logits, bias, temperature, least

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        c = len(self.names)
        sums, count = np.zeros((len(texts), c)), np.zeros(len(texts))
        held, owner, size = [], [], 0

        def flush():
            nonlocal held, owner, size
            if not held:
                return
            x = np.concatenate(held)
            who = np.repeat(np.array(owner), [len(p) for p in held])
            for at, h in grams(x):
                w = who[at]
                count_ = np.bincount(w, minlength=len(texts))
                count[:] += count_
                for j in range(c):
                    sums[:, j] += np.bincount(w, weights=self.logits[h, j], minlength=len(texts))
            held, owner, size = [], [], 0

        for i, t in enumerate(texts):
            for a, b in pieces(t or ""):
                part = codes(t[a:b])
                held.append(part)
                owner.append(i)
                size += len(part)
                if size >= PIECE:
                    flush()
        flush()
        p = np.zeros(len(texts))
        names = ["und"] * len(texts)
        if c:
            z = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            for i in np.nonzero(count)[0]:
                names[i], p[i] = self.names[q[i].argmax()], q[i].max()
        return names, p


def fit(texts: list[str], langs: list[str], seed: int = 11) -> LanguageModel:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    items = []
    for no, (t, lang) in enumerate(zip(texts, langs)):
        words, at, k = (t or "").split(), 0, 0
        while at < len(words):
            n = CHUNK_WORDS[k % len(CHUNK_WORDS)]
            k += 1
            parts = [h for _, h in grams(codes(" ".join(words[at : at + n])))]
            at += n
            f = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            if len(f):
                items.append((f, names.index(lang), no % KEPT_OUT == 0 and len(texts) >= 10 * KEPT_OUT))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, b = rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    train = [x for x in items if not x[2]]
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(train)):
            f, y, _ = train[i]
            rate = RATE * (1 - epoch / EPOCHS)
            h = emb[f].mean(0)
            z = h @ w + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(h, g)
            b -= rate * 0.1 * g
            np.subtract.at(emb, f, (rate * 20 / len(f)) * back[None, :])
    logits = emb @ w
    kept = [x for x in items if x[2]] or items
    z, y = np.array([logits[f].mean(0) + b for f, _, _ in kept]), np.array([y for _, y, _ in kept])

    def probs(t):
        q = np.exp((z - z.max(1, keepdims=True)) / t)
        return q / q.sum(1, keepdims=True)

    if not len(z):
        return LanguageModel([], logits[:, :0], b[:0], 1.0, 0.0)
    nll = {t: -np.log(probs(t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.2, 5, 25)}
    t = min(nll, key=nll.get)
    q = probs(t)
    right = q.max(1)[q.argmax(1) == y]
    return LanguageModel(names, logits.astype(np.float32), b, float(t), float(np.quantile(right, QUANTILE)) if len(right) else 0.0)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, held: Column) -> LanguageModel:
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held, F.lit(True)))
    chosen = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).orderBy("doc_id").select("x.*").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identifier(model: LanguageModel):
    """A column function of a text: struct<lang, score, rejected>."""
    bounded_batches(SparkSession.getActiveSession())
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def identify(texts: pd.Series) -> pd.DataFrame:
        names, p = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": names, "score": p, "rejected": [n == "und" or s < shared.value.least for n, s in zip(names, p)]})

    return identify


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 3) == 1
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), identifier(train(docs, held))("text").alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
