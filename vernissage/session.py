"""Session defaults and the checkpoint folder. A cluster's own settings always win."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "vernissage", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass the session you already have."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _work_folder(spark: SparkSession) -> str:
    """The shared folder the session names in `spark.checkpoint.dir`; a private one only where none
    is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and read it back, so that an iterative job
    survives the loss of an executor without replaying every round."""
    _work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """`df` as a columnar table in the checkpoint folder: computed once, then read by every branch
    of a plan with only the columns each needs."""
    spark = df.sparkSession
    path = f"{_work_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
