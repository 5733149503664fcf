"""Keyed tables in hash buckets: a batch rewrites the buckets its keys fall in and no others.

A version is a manifest, one row for each bucket that holds rows: the folder that is live for it. A new
version writes the touched buckets to folders of its own and names the rest as they were, so its cost
follows the batch, not the table; a bucket is always one folder, whatever the number of batches. Choose
`buckets` so that one is a task's work. The manifest is written last and at once, so readers see a whole
version or the one before; a batch that is run again writes the same version again. `vacuum` removes
what the versions that are kept do not name.

Defined cases: version 0 and a table without rows are empty; a bucket that loses its last row leaves the
manifest; a null key has a bucket like any other; opening a table with another number of buckets, or
rows outside the touched buckets, are refused."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "bucket int, folder string, buckets int"


def _folders(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()] if files.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets that the keys of `batch` fall in: no more than there are buckets."""
        return sorted(r.bucket for r in batch.select(self.bucket().alias("bucket")).distinct().collect())

    def versions(self) -> list[int]:
        """Versions that are complete, oldest first."""
        found = [f for f in _folders(self.spark, f"{self.path}/manifest") if f.startswith("v=")]
        return sorted(int(f[2:]) for f in found if _exists(self.spark, f"{self.path}/manifest/{f}/_SUCCESS"))

    def manifest(self, version: int) -> dict[int, str]:
        """The live folder of each bucket that holds rows."""
        if version == 0:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={version}").collect()
        if any(r.buckets != self.buckets for r in rows):
            raise ValueError(f"{self.path}: written with {rows[0].buckets} buckets, opened with {self.buckets}")
        return {r.bucket: r.folder for r in rows}

    def at(self, version: int, only: Collection[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: no other file is opened."""
        live = self.manifest(version)
        folders = sorted({f for b, f in live.items() if only is None or b in only})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def rewrite(self, version: int, touched: Collection[int], rows: DataFrame) -> dict[int, str]:
        """Version `version` + 1: `rows` are all rows of the touched buckets, the others stay."""
        live = {b: f for b, f in self.manifest(version).items() if b not in set(touched)}
        folder = f"data/v={version + 1}"
        if touched:
            dealt = rows.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
            written = [f for f in _folders(self.spark, f"{self.path}/{folder}") if f.startswith("bucket=")]
            fresh = {int(f.removeprefix("bucket=")): f"{folder}/{f}" for f in written}
            if not fresh.keys() <= set(touched):
                raise ValueError(f"{self.path}: rows in buckets {sorted(fresh.keys() - set(touched))}, which the batch does not touch")
            live |= fresh
        named = self.spark.createDataFrame([(b, f, self.buckets) for b, f in sorted(live.items())], _MANIFEST)
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version + 1}")
        return live

    def vacuum(self, keep: int = 2) -> int:
        """Removes older versions than the last `keep`, and the folders none of those names; returns how
        many folders went."""
        versions = self.versions()
        if not versions:
            return 0
        named = {f for v in versions[-keep:] for f in self.manifest(v).values()}
        gone = 0
        for v in _folders(self.spark, f"{self.path}/data"):
            if int(v.removeprefix("v=")) > versions[-1]:
                continue  # a version that is being written
            held = [f for f in _folders(self.spark, f"{self.path}/data/{v}") if f.startswith("bucket=")]
            dead = [f for f in held if f"data/{v}/{f}" not in named]
            for f in dead if len(dead) < len(held) else []:
                _delete(self.spark, f"{self.path}/data/{v}/{f}")
            if len(dead) == len(held):
                _delete(self.spark, f"{self.path}/data/{v}")
            gone += len(dead)
        for v in versions[:-keep]:
            _delete(self.spark, f"{self.path}/manifest/v={v}")
        return gone
