"""Stored keyed tables: rows in hash buckets of their key, merged bucket by bucket.

Layout under the table's folder::

    data/<token>/bucket=<b>/*.parquet     written once, never changed
    versions/<n>.json                     which folders make up version n

A merge reads and rewrites only the buckets that incoming keys touch, into a
new folder, and publishes the result in one step: the next version file is
written beside and renamed into place.  A merge that dies half way leaves
folders that no version names, so readers still see the version before.  A
version file holds one entry a bucket; the number of buckets is fixed when the
table is made.  One writer at a time: a second one fails when it finds its
version number taken.  ``vacuum`` removes folders of older versions.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.rank import distributed_rank
from riskloom.operators.store import DuplicateKeyError, merge
from riskloom.session import materialize

BUCKET = "bucket"


class ConcurrentMergeError(RuntimeError):
    pass


class _Files:
    """The few file operations a version needs, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm = spark._jvm

    def path(self, p: str):
        return self.hadoop.Path(p)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, p: str, text: str) -> None:
        """Write beside and rename into place; fails when ``p`` exists."""
        beside = f"{p}.{os.urandom(4).hex()}.tmp"
        stream = self.fs.create(self.path(beside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.path(p)) or not self.fs.rename(self.path(beside), self.path(p)):
            self.fs.delete(self.path(beside), False)
            raise ConcurrentMergeError(f"{p} was published by another writer")

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


@dataclass
class MergeResult:
    """What a merge did.  ``changes`` has every stored row it replaced, with sign
    -1, and every row it wrote in their place or inserted, with sign 1."""
    version: int
    inserted: int
    updated: int
    changes: DataFrame


class KeyedTable:
    """A stored table with one row per ``key``, optionally with a surrogate
    ``identity`` column (1, 2, ... in order of first insertion, never changed)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "user_id", identity: str | None = None, buckets: int = 32):
        self.spark, self.root, self.key, self.identity, self.buckets = spark, path.rstrip("/"), key, identity, buckets
        self.files = _Files(spark, self.root)

    # ------------------------------------------------------------- versions
    def version(self) -> dict:
        """The newest published version; an empty one before the first write."""
        numbers = [int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")]
        if not numbers:
            return {"version": 0, "schema": None, "buckets": {}, "rows": 0, "last_id": 0, "n_buckets": self.buckets}
        return json.loads(self.files.read(f"{self.root}/versions/{max(numbers):08d}.json"))

    def _publish(self, v: dict) -> None:
        self.files.publish(f"{self.root}/versions/{v['version']:08d}.json", json.dumps(v))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version (only some ``buckets`` of it, if given)."""
        v = self.version()
        if v["schema"] is None:
            raise ValueError(f"{self.root} holds no table yet")
        schema = T.StructType.fromJson(v["schema"])
        paths = [p for b, p in v["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self) -> None:
        """Remove folders that the newest version does not name."""
        used = {p.split("/data/")[1].split("/")[0] for p in self.version()["buckets"].values()}
        for token in self.files.names(f"{self.root}/data"):
            if token not in used:
                self.files.delete(f"{self.root}/data/{token}")

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, n: int) -> tuple[dict[str, str], DataFrame]:
        """Write ``rows`` into a new folder; its bucket folders, and the rows."""
        folder = f"{self.root}/data/{os.urandom(6).hex()}"
        # rebalance keeps a bucket's rows together and splits a bucket too large for one task
        rows.withColumn(BUCKET, self._bucket(n)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        found = [x.split("=")[1] for x in self.files.names(folder) if x.startswith(f"{BUCKET}=")]
        return {b: f"{folder}/{BUCKET}={b}" for b in found}, self.spark.read.schema(rows.schema).parquet(folder).select(rows.columns) if found else rows.limit(0)

    # --------------------------------------------------------------- writes
    def replace(self, rows: DataFrame) -> int:
        """Drop and recreate: ``rows`` become the whole table, in one step.  The
        table before stays readable until the new version is published."""
        v = self.version()
        held = materialize(rows, "replace")
        self._check_keys(held)
        if self.identity:
            held = distributed_rank(held, [F.col(self.key).asc()], self.identity, None)
            held = held.withColumn(self.identity, F.col(self.identity).cast("long"))
        buckets, _ = self._write(held, self.buckets)
        n = held.count()
        self._publish({"version": v["version"] + 1, "schema": held.schema.jsonValue(), "buckets": buckets, "rows": n, "last_id": n,
                       "n_buckets": self.buckets})
        return v["version"] + 1

    def _check_keys(self, rows: DataFrame, also: list[str] | None = None) -> None:
        """One aggregate: no null key, no key twice (per value of ``also``)."""
        per = rows.groupBy(self.key, *(also or [])).agg(F.count(F.lit(1)).alias("n"))
        worst = per.agg(F.max("n").alias("n"), F.count_if(F.col(self.key).isNull()).alias("nulls")).first()
        if worst["nulls"] or (worst["n"] or 0) > 1:
            raise DuplicateKeyError(f"null or duplicate values of {self.key} in merge input")

    def merge(self, incoming: DataFrame, payload: list[str], defaults: dict[str, Column] | None = None) -> MergeResult:
        """Upsert: incoming rows replace the ``payload`` columns of their key (a
        null is written), other columns keep the stored value; new keys are
        inserted with ``defaults`` (columns of ``incoming`` or constants) for
        the other columns and the next identities in key order."""
        defaults = defaults or {}
        payload = [c for c in payload if c != self.key]
        held = materialize(incoming.select(self.key, *payload, *[d.alias(f"_default_{c}") for c, d in defaults.items()]), "incoming")
        self._check_keys(held)
        return self._merge_written(held, payload, list(defaults))

    def merge_batches(self, incoming: DataFrame, batch: str, payload: list[str], defaults: dict[str, Column] | None = None) -> MergeResult:
        """Several loads at once, in the order of ``batch``: the result is that of
        merging them one by one.  Per key the last batch's payload wins and the
        first batch's defaults stay; a key twice inside one batch raises."""
        defaults = defaults or {}
        payload = [c for c in payload if c != self.key]
        held = materialize(incoming.select(self.key, F.col(batch).alias("_batch"), *payload, *[d.alias(f"_default_{c}") for c, d in defaults.items()]), "batches")
        self._check_keys(held, ["_batch"])
        first = [f"_default_{c}" for c in defaults]
        newest = F.max_by(F.struct(*payload), "_batch").alias("new")
        oldest = [F.min_by(F.struct(*first), "_batch").alias("old")] if first else []
        once = held.groupBy(self.key).agg(newest, *oldest).select(self.key, "new.*", *(["old.*"] if first else []))
        return self._merge_written(materialize(once, "incoming"), payload, list(defaults))

    def _merge_written(self, held: DataFrame, payload: list[str], defaults: list[str]) -> MergeResult:
        v = self.version()
        n_buckets = v["n_buckets"]
        touched = [r["b"] for r in held.select(self._bucket(n_buckets).alias("b")).distinct().collect()]  # at most n_buckets
        columns = [self.key, *payload, *defaults]
        types = {f.name: f.dataType for f in held.schema.fields}
        if v["schema"] is None:
            fields = [T.StructField(self.key, types[self.key])] + [T.StructField(c, types[c]) for c in payload]
            fields += [T.StructField(c, types[f"_default_{c}"]) for c in defaults]
            if self.identity:
                fields.append(T.StructField(self.identity, T.LongType()))
            old = self.spark.createDataFrame([], T.StructType(fields))
        else:
            old = self.read(touched)
        new = held.join(old.select(self.key), self.key, "left_anti")
        inserted = new.count()
        values = {c: F.col(f"new._default_{c}") for c in defaults}
        source = held
        if self.identity:
            ids = distributed_rank(new.select(self.key), [F.col(self.key).asc()], "_place", None)
            ids = ids.select(self.key, (F.col("_place") + F.lit(v["last_id"])).alias("_identity"))
            source = held.join(ids, self.key, "left")
            values[self.identity] = F.col("new._identity")
        extra = [c for c in source.columns if c not in columns]
        merged = merge(old.select(*[F.col(c) for c in old.columns], *[F.lit(None).cast(source.schema[c].dataType).alias(c) for c in extra]),
                       source, self.key, [*payload, *extra], values, check_unique=False).drop(*extra)
        buckets, written = self._write(merged, n_buckets)
        plus = written.join(held.select(self.key), self.key, "left_semi").withColumn("sign", F.lit(1))
        minus = old.join(held.select(self.key), self.key, "left_semi").withColumn("sign", F.lit(-1))
        self._publish({"version": v["version"] + 1, "schema": merged.schema.jsonValue(), "buckets": {**v["buckets"], **buckets},
                       "rows": v["rows"] + inserted, "last_id": v["last_id"] + inserted, "n_buckets": n_buckets})
        return MergeResult(v["version"] + 1, inserted, held.count() - inserted, minus.unionByName(plus))
