"""Snapshot history as a table: rows by run and write, and a published list of runs.

Every write has a write id that sorts by time. Its rows go to folders of their own,
``rows/run_id=<run>/write_id=<write>``, and nothing that is in force is touched. Then the
entries of its runs (``version`` = that write id) are published in a folder of the write,
``runs/published=<write>``. A reader takes, per run, the entry with the greatest version and
reads only the rows of that version. So a write that stops at any point leaves the previous
result readable: rows without an entry are never read, and an entry appears with its job's
commit. Writing a run again replaces it, also by nothing (an entry of 0 units and no rows).

``compact`` rewrites the list of runs as one folder of the entries in force, deletes the folders
it read, and then the row versions that no entry names any longer; each step leaves a readable
history. ``seq`` numbers the runs of a stream in the order in which they were done, ``batch``
names what they were done in.
"""

from __future__ import annotations

import datetime
import logging
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .partitions import has_files, partition_path

ROW_SCHEMA = (
    "run_ts timestamp, commit string, kind string, file_path string, name string, ordinal int, "
    "signature string, sql_type string, classification string, hash string, run_id string"
)
RUN_SCHEMA = (
    "run_ts timestamp, commit string, units long, seq long, batch string, run_id string"
)
ENTRY_SCHEMA = RUN_SCHEMA + ", version string, published string"
#: Folders in the list of runs beyond which a write compacts it.
COMPACT_AFTER = 32

_UNREADABLE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER")

log = logging.getLogger(__name__)


def new_write_id() -> str:
    """Ids of later writes sort after those of earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def one_run(
    spark: SparkSession, run_id: str, run_ts: datetime.datetime, commit: str | None = None
) -> DataFrame:
    return spark.createDataFrame(
        [(run_id, run_ts, commit)], "run_id string, run_ts timestamp, commit string"
    )


def write_rows(snap: DataFrame, table: str, write_id: str) -> None:
    """Step 1: the rows of a write, in folders of their own."""
    (
        snap.withColumn("write_id", F.lit(write_id))
        .write.mode("append")
        .partitionBy("run_id", "write_id")
        .parquet(f"{table}/rows")
    )


def publish(spark: SparkSession, table: str, runs: DataFrame, write_id: str) -> None:
    """Step 2: the entries of the runs of a write; units are counted on what was written."""
    ids = [r.run_id for r in runs.select("run_id").collect()]
    written = _read_versions(spark, table, {run: write_id for run in ids})
    counts = written.groupBy("run_id").agg(F.count("*").alias("units"))

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in runs.columns else F.lit(None).cast(kind).alias(name)

    entries = runs.join(counts, "run_id", "left").select(
        "run_ts",
        "commit",
        F.coalesce("units", F.lit(0)).cast("long").alias("units"),
        optional("seq", "long"),
        optional("batch", "string"),
        "run_id",
        F.lit(write_id).alias("version"),
        F.lit(write_id).alias("published"),
    )
    entries.coalesce(1).write.mode("append").partitionBy("published").parquet(f"{table}/runs")


def write_snapshot(snap: DataFrame, table: str, runs: DataFrame) -> None:
    """Add one or many runs to the history.

    ``runs`` (``run_id, run_ts, commit`` and, of a stream, ``seq, batch``) names the runs,
    since a run may have no unit at all; the driver holds their ids. ``snap`` is evaluated
    once. Nothing is deleted before the new rows and entries are there.
    """
    spark = snap.sparkSession
    write_id = new_write_id()
    write_rows(snap, table, write_id)
    publish(spark, table, runs, write_id)
    if len(_published(spark, table)) > COMPACT_AFTER:
        compact(spark, table)


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _children(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names after ``prefix`` of the sub-folders of ``folder`` whose names start with it."""
    filesystem, path = _fs(spark, folder)
    if not filesystem.exists(path):
        return []
    names = [s.getPath().getName() for s in filesystem.listStatus(path) if s.isDirectory()]
    return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))


def _published(spark: SparkSession, table: str) -> list[str]:
    return _children(spark, f"{table}/runs", "published=")


def entries(spark: SparkSession, table: str) -> DataFrame:
    """The entry in force of every run: the one with the greatest version."""
    listed = spark.read.schema(ENTRY_SCHEMA).option("basePath", f"{table}/runs").parquet(f"{table}/runs")
    best = listed.groupBy("run_id").agg(F.max_by(F.struct(*RUN_SCHEMA_COLUMNS, "version"), "version").alias("e"))
    return best.select("e.*")


def compact(spark: SparkSession, table: str) -> None:
    """One folder of entries in force for the list of runs; superseded rows removed."""
    folders = _published(spark, table)
    if not folders:
        return
    read = [partition_path(spark, f"{table}/runs", "published", p) for p in folders]
    listed = spark.read.schema(ENTRY_SCHEMA).option("basePath", f"{table}/runs").parquet(*read)
    best = listed.groupBy("run_id").agg(F.max_by(F.struct(*RUN_SCHEMA_COLUMNS, "version"), "version").alias("e"))
    write_id = new_write_id()
    best.select("e.*", F.lit(write_id).alias("published")).coalesce(1).write.mode("append").partitionBy(
        "published"
    ).parquet(f"{table}/runs")
    for path in read:  # covered by the compacted folder
        filesystem, folder = _fs(spark, path)
        filesystem.delete(folder, True)
    in_force = {r.run_id: r.version for r in entries(spark, table).select("run_id", "version").collect()}
    for run, version in in_force.items():
        runs_rows = partition_path(spark, f"{table}/rows", "run_id", run)
        for old in _children(spark, runs_rows, "write_id="):
            if old < version:  # never a newer one: its write may still go on
                filesystem, folder = _fs(spark, f"{runs_rows}/write_id={old}")
                filesystem.delete(folder, True)


def _read_versions(spark: SparkSession, table: str, versions: dict[str, str]) -> DataFrame:
    """Rows of the given version of each run; only these folders are listed and read."""
    folders = []
    for run, version in versions.items():
        folder = f"{partition_path(spark, f'{table}/rows', 'run_id', run)}/write_id={version}"
        if version and has_files(spark, folder):
            folders.append(folder)
    if not folders:
        return spark.createDataFrame([], ROW_SCHEMA)
    found = spark.read.schema(ROW_SCHEMA + ", write_id string").option("basePath", f"{table}/rows")
    return found.parquet(*folders).select(*ROW_SCHEMA_COLUMNS)


ROW_SCHEMA_COLUMNS = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
RUN_SCHEMA_COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]


def read_rows(spark: SparkSession, table: str, run_ids: list[str] | None = None) -> DataFrame:
    """Rows in force of the named runs, whose folders alone are read; of all runs without names.

    The driver holds one entry per run asked for (or per run of the history).
    """
    try:
        wanted = entries(spark, table)
    except (PySparkException, Py4JJavaError) as e:
        if not any(c in str(e) for c in _UNREADABLE):
            raise
        return spark.createDataFrame([], ROW_SCHEMA)
    if run_ids is not None:
        wanted = wanted.where(F.col("run_id").isin(list(dict.fromkeys(run_ids))))
    versions = {r.run_id: r.version for r in wanted.select("run_id", "version").collect()}
    return _read_versions(spark, table, versions)


def _last(spark: SparkSession, table: str, wanted: Column | None, order: Column):
    """``run_id, seq`` of the last wanted run; None if the list is missing or unreadable."""
    try:
        runs = entries(spark, table)
        if wanted is not None:
            runs = runs.filter(wanted)
        return runs.agg(F.max_by(F.struct("run_id", "seq"), order)).first()[0]
    except (PySparkException, Py4JJavaError) as e:
        # any other failure, such as lost executors, must not pass for a first run
        reason = next((c for c in _UNREADABLE if c in str(e)), None)
        if reason is None:
            raise
        log.warning("no previous snapshot: %s", reason)
        return None


def latest_run(
    spark: SparkSession, table: str, before: datetime.datetime | None = None
) -> str | None:
    """Id of the newest finished run, or of the newest one before a point in time.

    A missing or unreadable list of runs gives None and a warning.
    """
    wanted = None if before is None else F.col("run_ts") < F.lit(before)
    found = _last(spark, table, wanted, F.struct("run_ts", "run_id"))
    return found and found.run_id


def last_done(spark: SparkSession, table: str, batch: str | None) -> tuple[str | None, int]:
    """Id and number of the run that was done last, those of ``batch`` left out."""
    wanted = None if batch is None else ~F.col("batch").eqNullSafe(batch)
    order = F.struct(F.coalesce("seq", F.lit(0)), "run_ts", "run_id")
    found = _last(spark, table, wanted, order)
    return (found.run_id, found.seq or 0) if found else (None, 0)


def latest_snapshot(
    spark: SparkSession, table: str, before: datetime.datetime | None = None
) -> DataFrame | None:
    """Rows of the newest run, or None. Only the folder of that run is listed and read."""
    run_id = latest_run(spark, table, before)
    if run_id is None:
        return None
    return read_rows(spark, table, [run_id])
