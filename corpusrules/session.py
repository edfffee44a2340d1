"""A session with the settings this library is tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "corpusrules", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "8g")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder will do, but only if driver and
    executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="corpusrules-", dir=os.environ.get("TMPDIR"))
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Repartition a scan by ``key`` only if it has fewer splits than the cluster has cores.

    A small table in one row group would otherwise be parsed by one task; a large
    one is already split evenly by bytes and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *key)


def keep(df: DataFrame) -> DataFrame:
    """Checkpoint rows that several branches of a plan read, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
