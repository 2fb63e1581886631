"""The chunk table: Parquet buckets under versioned manifests, with upsert, pruning, deletes, changes and fences."""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version; new rows win ties. A union and one aggregation."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [f.name for f in both.schema.fields if f.name not in (*key, "_new")]
    # Rows of one version: the larger hash of what can be hashed, so that a retry picks the same one.
    plain = [f.name for f in both.schema.fields if f.name in rest and not isinstance(f.dataType, MapType)]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new", F.xxhash64(*plain))).alias("_m"))
    return best.select(*key, "_m.*").select(*[c for c in both.columns if c != "_new"])


def prune_stale(chunks: DataFrame, current: DataFrame) -> DataFrame:
    """chunks without those beyond their document's current number; current: source_key, doc_id, total_chunks."""
    now = current.select("source_key", "doc_id", F.col("total_chunks").alias("_total"))
    return chunks.join(now, ["source_key", "doc_id"], "left").filter(F.col("_total").isNull() | (F.col("chunk_index") < F.col("_total"))).drop("_total")


def delete_where(table: DataFrame, doomed: Column) -> DataFrame:
    return table.filter(~F.coalesce(doomed, F.lit(False)))


def info(table: DataFrame, vector: str) -> DataFrame:
    return table.agg(F.count("*").alias("points"), F.count(vector).alias("vectors"))


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


#: Times a write starts again after another writer came first.
RETRIES = 5


class ChunkStore:
    """Rows in buckets by hash of their key, under numbered manifests: the newest manifest is the table.

    A bucket is named by the first bits of its keys' hashes, and a manifest lists buckets of any depth that cover all
    hashes, each with its folder (one file) and its number of rows. An upsert reads and writes only the buckets
    that its rows fall into, and those that would pass `limit` rows are split by further bits, so no task writes more than
    about that. Deletes write the keys that go, beside the buckets they are in; a read leaves these keys out, and
    the next upsert of the bucket drops them for good.

    A manifest is written under a name of its own and renamed to the next number, which fails if that exists (the rename
    must be atomic and must not overwrite: HDFS and local disks, not plain object stores). The loser of two writers keeps its files if the
    winner left its buckets as they were, and else starts again. Readers see a whole version. A `fence`
    (writer, batch) is kept in the manifest: a batch that isn't newer than its writer's last one changes nothing.
    vacuum() deletes folders that no kept manifest names.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, limit: int = 1_000_000):
        self.spark, self.root, self.limit = spark, root.rstrip("/"), limit
        self.depth = max(0, (buckets - 1).bit_length())

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, at = self._fs(), self._path("manifests")
        return sorted(int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _manifest(self, number: int | None = None) -> tuple[int, dict | None]:
        numbers = self._numbers()
        if not numbers:
            return 0, None
        number = numbers[-1] if number is None else number
        rows = self.spark.read.text(f"{self.root}/manifests/{number:012d}.json").collect()
        return number, json.loads(rows[0][0])

    def _publish(self, number: int, manifest: dict) -> None:
        # A name of its own first: a manifest is there whole or not at all.
        sc = self.spark.sparkContext
        draft, final = self._path("manifests", f"{number:012d}.{uuid.uuid4().hex}.draft"), self._path("manifests", f"{number:012d}.json")
        fs = self._fs()
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), sc._jsc.hadoopConfiguration())
        none = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(f"version {number} was written by another writer") from None
            raise

    def _labels(self, manifest: dict | None) -> list[str]:
        return sorted(manifest["labels"]) if manifest else [format(i, f"0{self.depth}b") if self.depth else "" for i in range(2**self.depth)]

    def _dealt(self, rows: DataFrame, key: list[str], labels: list[str]) -> DataFrame:
        """rows with _bucket, the label that begins the hash of their key: met by a directory of the labels, which the manifest bounds."""
        depth = max(map(len, labels))
        bits = F.shiftrightunsigned(F.xxhash64(*(F.col(k).cast("string") for k in key)), 64 - depth) if depth else F.lit(0).cast("long")
        entries = [(int(x or "0", 2) * 2 ** (depth - len(x)) + i, f"b{x}") for x in labels for i in range(2 ** (depth - len(x)))]
        directory = self.spark.createDataFrame(entries, "_bits long, _bucket string")
        return rows.withColumn("_bits", bits).join(F.broadcast(directory), "_bits").drop("_bits")

    def _read(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = lambda kind: [f"{self.root}/{p}" for b, x in sorted(manifest["buckets"].items()) if only is None or b in only for p in x.get(kind, [])]
        rows = self.spark.read.schema(schema).parquet(*paths("data")) if paths("data") else self.spark.createDataFrame([], schema)
        if paths("gone"):
            keys = self.spark.read.schema(StructType([schema[k] for k in manifest["key"]])).parquet(*paths("gone"))
            rows = rows.join(keys, manifest["key"], "left_anti").select(*schema.names)
        return rows

    def _counts(self, rows: DataFrame, key: list[str], labels: list[str]) -> dict[str, int]:
        """Rows of each bucket: a row a bucket comes to the driver."""
        return {r[0][1:]: r[1] for r in self._dealt(rows.select(*key), key, labels).groupBy("_bucket").count().collect()}

    def _written(self, number: int, rows: DataFrame, key: list[str], labels: list[str], kind: str) -> dict[str, dict]:
        """Writes rows in buckets; what the manifest says of each."""
        folder = f"{kind}/{number:012d}-{uuid.uuid4().hex}"
        self._dealt(rows, key, labels).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        if not self._fs().exists(self._path(folder)):
            return {}
        found = self.spark.read.option("recursiveFileLookup", "true").schema(rows.select(*key).schema).parquet(f"{self.root}/{folder}")
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/_bucket=b([01]*)/", 1)
        return {r[0]: {kind: [f"{folder}/_bucket=b{r[0]}"], "rows": r[1]} for r in found.groupBy(at.alias("b")).count().collect()}

    def _commit(self, number: int, manifest: dict, change, touched: set[str]) -> None:
        """Publishes change(manifest). If others came first and left the touched buckets as they were, what they made is changed in the same way."""
        while True:
            try:
                return self._publish(number + 1, change(manifest))
            except Conflict:
                number, now = self._manifest()
                same = all(now["buckets"].get(b) == manifest["buckets"].get(b) for b in touched) and touched <= set(now["labels"])
                if not same or now["key"] != manifest["key"]:
                    raise
                manifest = now

    def _base(self, schema: StructType, key: list[str]) -> dict:
        return {"key": key, "schema": schema.jsonValue(), "labels": self._labels(None), "buckets": {}, "fences": {}}

    def ensure(self, schema: str, key: list[str]) -> DataFrame:
        """The table, made empty with this schema if it is missing."""
        if self._manifest()[1] is None:
            try:
                self._publish(1, self._base(self.spark.createDataFrame([], schema).schema, key))
            except Conflict:
                pass
        return self.read()

    def read(self, number: int | None = None) -> DataFrame | None:
        """The newest version, or that of a number."""
        manifest = self._manifest(number)[1]
        return self._read(manifest) if manifest else None

    def get(self, keys: DataFrame) -> DataFrame | None:
        """Rows of some keys, read from the buckets that these fall into alone."""
        manifest = self._manifest()[1]
        if manifest is None:
            return None
        key = manifest["key"]
        only = set(self._counts(keys, key, self._labels(manifest)))
        return self._read(manifest, only).join(keys.select(*key).distinct(), key, "left_semi")

    def upsert(self, new: DataFrame, key: list[str], version: str, fence: tuple[str, int] | None = None) -> bool:
        """The row of each key with the largest version stays. False if the fence has seen the batch, or if there are no rows."""
        for left in range(RETRIES, -1, -1):
            number, manifest = self._manifest()
            if manifest and manifest["key"] != key:
                raise ValueError(f"the key of this table is {manifest['key']}")
            if fence and manifest and manifest["fences"].get(fence[0], -1) >= fence[1]:
                return False
            manifest = manifest or self._base(new.schema, key)
            labels = self._labels(manifest)
            more = self._counts(new, key, labels)
            if not more and not fence:
                return False
            # Buckets that might pass the limit are split by as many bits as that takes.
            deeper = {}
            for b, n in more.items():
                most = n + manifest["buckets"].get(b, {}).get("rows", 0)
                bits = min(max(0, math.ceil(math.log2(most / self.limit))) if most > self.limit else 0, 32)
                deeper[b] = [b + format(i, f"0{bits}b") if bits else b for i in range(2**bits)]
            old = self._read(manifest, set(more))
            whole = [x for b in labels for x in deeper.get(b, [b])]
            made = self._written(number + 1, upsert(old, new, key, version), key, whole, "data") if more else {}
            fields = {f.name: f for f in StructType.fromJson(manifest["schema"]).fields} | {f.name: f for f in new.schema.fields}

            def change(now):
                known = {f.name: f for f in StructType.fromJson(now["schema"]).fields}
                held = {b: x for b, x in now["buckets"].items() if b not in more} | made
                fences = now["fences"] | ({fence[0]: fence[1]} if fence else {})
                names = [x for b in now["labels"] for x in deeper.get(b, [b])]
                return now | {"schema": StructType(list((known | fields).values())).jsonValue(), "labels": names, "buckets": held, "fences": fences}

            try:
                if number == 0:
                    self._publish(1, change(manifest))
                else:
                    self._commit(number, manifest, change, set(more))
                return True
            except Conflict:
                if not left:
                    raise
        return False

    def delete(self, doomed: Column) -> None:
        """Rows for which doomed holds go: their keys are written, no bucket is."""
        self._delete(lambda rows: rows.filter(doomed))

    def prune(self, current: DataFrame) -> None:
        """Rows beyond their document's current number of chunks go (current: source_key, doc_id, total_chunks)."""
        now = current.select("source_key", "doc_id", F.col("total_chunks").alias("_total"))
        self._delete(lambda rows: rows.join(now, ["source_key", "doc_id"]).filter(F.col("chunk_index") >= F.col("_total")))

    def _delete(self, doomed) -> None:
        for left in range(RETRIES, -1, -1):
            number, manifest = self._manifest()
            if manifest is None:
                return
            made = self._written(number + 1, doomed(self._read(manifest)).select(*manifest["key"]), manifest["key"], self._labels(manifest), "gone")
            if not made:
                return

            def change(now):
                held = {b: x | {"gone": x.get("gone", []) + made[b]["gone"], "rows": x["rows"] - made[b]["rows"]} if b in made else x for b, x in now["buckets"].items()}
                return now | {"buckets": {b: x for b, x in held.items() if x["rows"] > 0}}

            try:
                return self._commit(number, manifest, change, set(made))
            except Conflict:
                if not left:
                    raise

    def changes(self, old: int, new: int) -> DataFrame:
        """Keys that differ between two versions: the key, change (added, changed or removed), and before and after, the rows of both as structs.

        Buckets with the same folders in both aren't read; a split bucket differs, and so do its parts.
        """
        one, two = self._manifest(old)[1], self._manifest(new)[1]
        key = two["key"]
        files = lambda x: (x.get("data"), x.get("gone", []))
        differ = lambda a, b: {n for n, x in a["buckets"].items() if n not in b["buckets"] or files(b["buckets"][n]) != files(x)}
        names = StructType.fromJson(two["schema"]).names
        left, right = self._read(one, differ(one, two)), self._read(two, differ(two, one))
        for n in names:
            if n not in left.columns:
                left = left.withColumn(n, F.lit(None).cast(right.schema[n].dataType))
        both = left.select(*key, F.struct(*names).alias("before")).join(right.select(*key, F.struct(*names).alias("after")), key, "full_outer")
        plain = [f.name for f in right.schema.fields if not isinstance(f.dataType, MapType)]
        maps = [n for n in names if n not in plain]
        same = F.lit(True)
        for n in names:
            each = (lambda c: F.array_sort(F.map_entries(c))) if n in maps else (lambda c: c)
            same = same & each(F.col("before")[n]).eqNullSafe(each(F.col("after")[n]))
        what = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~same, "changed")
        return both.withColumn("change", what).filter(F.col("change").isNotNull()).select(*key, "change", "before", "after")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest `keep` manifests, and the folders that none of those names. Not beside a running writer."""
        numbers = self._numbers()
        named = {p for n in numbers[-keep:] for x in self._manifest(n)[1]["buckets"].values() for kind in ("data", "gone") for p in x.get(kind, [])}
        fs = self._fs()
        for n in numbers[:-keep]:
            fs.delete(self._path("manifests", f"{n:012d}.json"), False)
        for kind in ("data", "gone"):
            for folder in fs.listStatus(self._path(kind)) if fs.exists(self._path(kind)) else []:
                for part in fs.listStatus(folder.getPath()):
                    name = f"{kind}/{folder.getPath().getName()}/{part.getPath().getName()}"
                    if name not in named:
                        fs.delete(part.getPath(), True)
