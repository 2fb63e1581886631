"""Token counts through a digest cache.

The cache is a Parquet folder with a row for each text that was ever encoded: the digest of the
content, the digest of the tokenizer's file, and the counts. A call joins the digests of its texts to
the stored ones, encodes only the distinct texts that have none, appends those, and joins again.

Texts are grouped by digest with a map-side combine before they are shuffled, so many copies of one
text cost a row for each map task. A digest with more than a thousandth of all rows gets its count by a
broadcast (there can't be a thousand of them); the others are joined to theirs, narrow row by row.

Encoding: the library named by the file's ending gives the counts. For the byte-level file, texts with
no special string and only characters whose Unicode classes are old and fixed go through a faster
library over the same vocabulary, which gives the same tokens; all others go through the first.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results;
texts of any length are counted whole; an empty table gives an empty one; input columns n_bytes and
n_tokens give way to the new ones, and names that begin with `__lw_` are reserved.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, bounded_batches, shared_dir, table

CACHE_CONF = "spark.lodeworks.tokenCache"
LIMIT = 1024
#: Characters whose classes differ in no Unicode version the libraries may have: Latin, and general punctuation.
_PLAIN = re.compile("[^\x00-ɏ‐-‧]")
_LONG = 100_000

_made: dict[tuple, object] = {}


def _counter(path: str, fast: str | None):
    """texts -> token counts, for one worker."""
    if (path, fast) in _made:
        return _made[path, fast]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_padding()
        own.no_truncation()
        special = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
        slow = lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
        if fast:
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(fast, "rb"))}
            quick = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def count(texts):
                odd = [len(t) > _LONG or any(s in t for s in special) or bool(_PLAIN.search(t)) for t in texts]
                rest = iter(slow([t for t, o in zip(texts, odd) if o]))
                return [next(rest) if o else len(quick.encode_ordinary(t)) for t, o in zip(texts, odd)]

        else:
            count = slow
    _made[path, fast] = count
    return count


def _encoder(path: str, fast: str | None):
    def encode(batches):
        count = _counter(path, fast)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({"content": part["content"], "n_tokens": count(part["body"].tolist())})

    return encode


def version_of(path: str) -> str:
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, fast: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_bytes and n_tokens of each text, in place of columns of these names.

    cache: a folder that driver and executors share; made if missing. tokenizer: a file that every machine has.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    bounded_batches(spark)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    # columns of docs travel under names of our own, so none can clash with what is made here
    held = [f"in{i}" for i in range(len(names))]
    docs = docs.select(*(F.col(c).alias(h) for c, h in zip(names, held)), F.col(text).alias("_text"))
    body = F.coalesce(F.col("_text"), F.lit(""))
    digest = F.unhex(F.sha2(body, 256))
    stored_at = f"{cache.rstrip('/')}/{version}"
    schema = "content binary, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(stored_at)
    stored = lambda: spark.read.schema(schema).parquet(stored_at)
    # First the digests alone: only texts with a missing digest are carried further.
    texts = docs.select(digest.alias("content"), body.alias("body"))
    if not stored().isEmpty():
        texts = texts.join(stored(), "content", "left_anti")
    misses = texts.groupBy("content").agg(F.first("body").alias("body"))
    misses.mapInPandas(_encoder(tokenizer, fast), schema).write.mode("append").parquet(stored_at)
    known = stored().groupBy("content").agg(F.max("n_tokens").alias("_tokens"))
    slim = docs.select(*held, digest.alias("__lw_key"), F.octet_length(body).cast("long").alias("__lw_bytes"))
    many = docs.select(digest.alias("content")).groupBy("content").agg(F.count("*").alias("rows"))
    total = docs.count()
    hot = known.join(F.broadcast(many.filter(F.col("rows") > total // HOT_SHARE).select("content")), "content").select(F.col("content").alias("__lw_key"), F.col("_tokens").alias("__lw_hot"))
    slim = slim.join(F.broadcast(hot), "__lw_key", "left")
    # A row whose count is known already goes anywhere: a longer key has no equal in the cache.
    spread = F.when(F.col("__lw_hot").isNull(), F.col("__lw_key")).otherwise(F.concat("__lw_key", F.unhex(F.hex(F.xxhash64(*held)))))
    joined = slim.withColumn("__lw_key", spread).join(known.withColumnRenamed("content", "__lw_key"), "__lw_key", "left")
    return joined.select(*(F.col(h).alias(c) for c, h in zip(names, held)), F.col("__lw_bytes").alias("n_bytes"), F.coalesce("__lw_hot", "_tokens").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own for each call, unless the session names a lasting one."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = spark.conf.get(CACHE_CONF, None) or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    counted = count_tokens(docs.withColumnRenamed("text", "_t"), cache, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), "_t")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
