"""Versioned tables: each write is a whole new version, published by moving one pointer."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "_current"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _published(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each published version."""
    files, at = _files(spark, path)
    if not files.exists(at(path)):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(at(path))]
    pointers = [n.removeprefix(_POINTER + "-").split("-", 1) for n in names if n.startswith(_POINTER + "-")]
    # Two writers can name the same version; the one that readers see is the first by name.
    return {int(v): folder for v, folder in sorted(pointers, reverse=True)}


def current_version(spark: SparkSession, path: str) -> int:
    """The published version, 0 when there is none."""
    return max(_published(spark, path), default=0)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    versions = _published(spark, path)
    if not versions:
        raise ValueError(f"{path}: nothing published")
    return spark.read.parquet(f"{path}/{versions[max(versions)]}")


def write_snapshot(df: DataFrame, path: str, key: Sequence[str], *, dry_run: bool = False) -> int:
    """Write `df` as the next version and publish it; returns the version (unchanged on a dry run,
    which checks and publishes nothing). A key that repeats is refused.

    Data go to a folder of their own, whose name is in the pointer: an empty file created once they
    are complete. Readers see the old version or the new one, never a part, and a second writer
    neither touches the first one's data nor hides that it lost: it is refused."""
    spark = df.sparkSession
    files, at = _files(spark, path)
    before = current_version(spark, path)
    if dry_run:
        _refuse_repeats(df, path, key)
        return before
    folder = f"v{before + 1}-{uuid.uuid4().hex}"
    target = f"{path}/{folder}"
    df.write.parquet(target)
    try:
        _refuse_repeats(spark.read.schema(df.schema).parquet(target), path, key)
    except ValueError:
        files.delete(at(target), True)
        raise
    pointer = at(f"{path}/{_POINTER}-{before + 1}-{folder}")
    files.create(pointer, False).close()
    if _published(spark, path)[before + 1] != folder or current_version(spark, path) != before + 1:
        files.delete(pointer, False)
        files.delete(at(target), True)
        raise ValueError(f"{path}: another writer published version {before + 1}")
    return before + 1


def _refuse_repeats(df: DataFrame, path: str, key: Sequence[str]) -> None:
    if df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError(f"{path}: a key ({', '.join(key)}) repeats")
