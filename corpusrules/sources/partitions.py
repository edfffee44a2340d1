"""Named partitions of a Parquet table, so that cost follows what is asked for, not what was ever written."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def partition_path(spark: SparkSession, table: str, column: str, value: str) -> str:
    """Folder of one partition, its value written as Spark writes it."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"{table}/{column}={names.escapePathName(value)}"


def _open(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether the folder holds anything but the hidden files of a write that still goes on."""
    filesystem, path = _open(spark, folder)
    if not filesystem.exists(path):
        return False
    found = filesystem.listStatusIterator(path)
    while found.hasNext():
        if not found.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def read_partitions(
    spark: SparkSession, table: str, schema: str | StructType, column: str, values: Iterable[str]
) -> DataFrame:
    """Rows of the named partitions; those that do not exist have none.

    Only these folders are listed and read. The names are held by the driver, so give a
    bounded number of them.
    """
    folders = [partition_path(spark, table, column, v) for v in dict.fromkeys(values)]
    folders = [f for f in folders if has_files(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", table).parquet(*folders)


def drop_partitions(spark: SparkSession, table: str, column: str, values: Iterable[str]) -> None:
    """Delete the named partitions, so that a later write without rows for one leaves none."""
    for value in values:
        filesystem, path = _open(spark, partition_path(spark, table, column, value))
        filesystem.delete(path, True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no later step reads."""
    filesystem, path = _open(spark, folder)
    filesystem.delete(path, True)
