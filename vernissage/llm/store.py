"""Intermediate tables in the shared folder, and the checks every operator shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from vernissage.session import _work_folder


_SHIPPED: set[str] = set()
BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once an application, so that they need no copy of it, and
    keep the batches they get small unless the session says otherwise."""
    context = spark.sparkContext
    if spark.conf.get(BATCH, None) in (None, DEFAULT_BATCH):
        spark.conf.set(BATCH, "1000")  # rows of long texts stay within a worker's memory
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "vernissage_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


class Store:
    """Parquet tables of one run below `spark.checkpoint.dir`. A stage that is read twice is written
    once, survives lost executors, and is removed with `drop` when nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{_work_folder(spark)}/llm-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.clean()
        return self.spark.read.schema(df.schema).parquet(path)

    def get(self, name: str, schema: str) -> DataFrame:
        """The tables put below `name` as one."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.clean()

    def clean(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
