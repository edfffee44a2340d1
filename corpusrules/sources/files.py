"""Source trees as a table: ``(file_path, content, error)``.

Spark's own file listing hides every name that starts with an underscore, which
would lose ``__init__.py``. So a tree is read in two steps, both on executors:
a small data source lists names and sizes, then the paths are spread evenly and
each task reads its files. The driver sees the folders near the root only.
Land a tree once with ``land_sources`` and let analytics read that table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .partitions import partition_path, read_partitions

# Directories that are never entered. Names that start with a dot are not either.
SKIPPED_DIRECTORIES = ("node_modules", "__pycache__", "venv", ".venv")
SQL_SKIPPED_DIRECTORIES = ("node_modules",)
SUFFIXES = {"py": ".py", "sql": ".sql", "py_sql": ".py"}

SCHEMA = "file_path string, content string, error string"
LANDED_SCHEMA = f"{SCHEMA}, commit string"
# listing tasks to aim for: folders are opened on the driver until there are so many
_LISTING_TASKS = 64
# bytes of source text per record batch
_BATCH_BYTES = 16 * 1024 * 1024


def _filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """File system and folder (with a final slash) of a path or an address."""
    if "://" in root or root.startswith("file:"):
        filesystem, path = fs.FileSystem.from_uri(root)
    else:
        filesystem, path = fs.LocalFileSystem(), root
    return filesystem, path.rstrip("/") + "/"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _ListingReader(DataSourceReader):
    """Wanted files below a root. A folder that no kind of file wants is not opened."""

    def __init__(self, root: str, suffixes: tuple[str, ...], skipped: dict[str, tuple[str, ...]]):
        self.root, self.suffixes, self.skipped = root, suffixes, skipped
        self.never = set.intersection(*(set(skipped.get(s, ())) for s in suffixes))

    def _wanted(self, path: str) -> bool:
        *folders, name = path.split("/")
        suffix = next((s for s in self.suffixes if name.endswith(s)), None)
        if suffix is None or name.startswith("."):
            return False
        return not any(f in self.skipped.get(suffix, ()) for f in folders)

    def _open(self, filesystem, base: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Sub-folders and wanted files of one folder, relative to the root.

        Links to folders are not entered. A folder that cannot be opened is listed as
        if it were a file, so that reading it gives its error row; the root must open.
        """
        folders, files = [], []
        try:
            found = filesystem.get_file_info(fs.FileSelector(base + folder))
        except OSError:
            if not folder:
                raise
            return [], [(folder, 0)]
        local = isinstance(filesystem, fs.LocalFileSystem)
        for info in found:
            path = info.path.removeprefix(base)
            if info.type == fs.FileType.Directory:
                skipped = info.base_name.startswith(".") or info.base_name in self.never
                if not skipped and not (local and os.path.islink(info.path)):
                    folders.append(path)
            elif self._wanted(path):
                files.append((path, info.size or 0))
        return folders, files

    def partitions(self) -> list[InputPartition]:
        filesystem, base = _filesystem(self.root)
        opened: list[str] = []
        level = [""]
        while level and len(level) < _LISTING_TASKS:
            opened += level
            level = [f for folder in level for f in self._open(filesystem, base, folder)[0]]
        return [_Folder(f, False) for f in opened] + [_Folder(f, True) for f in level]

    def read(self, partition: _Folder) -> Iterator[tuple[str, int]]:
        filesystem, base = _filesystem(self.root)
        todo = [partition.path]
        while todo:
            folders, files = self._open(filesystem, base, todo.pop())
            yield from files
            if partition.deep:
                todo += folders


class SourceListing(DataSource):
    """``spark.read.format("source_listing")``; options ``path`` and ``suffixes``."""

    @classmethod
    def name(cls) -> str:
        return "source_listing"

    def schema(self) -> str:
        return "file_path string, n_bytes long"

    def reader(self, schema) -> DataSourceReader:
        suffixes = tuple(self.options.get("suffixes", ".py,.sql").split(","))
        skipped = {".py": SKIPPED_DIRECTORIES, ".sql": SQL_SKIPPED_DIRECTORIES}
        return _ListingReader(self.options["path"], suffixes, skipped)


def list_sources(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """``(file_path, n_bytes)`` of the files below ``root``, paths relative to it."""
    spark.dataSource.register(SourceListing)
    suffixes = SUFFIXES[kind] if kind else ".py,.sql"
    return spark.read.format("source_listing").option("suffixes", suffixes).load(root)


def read_tree(spark: SparkSession, root: str, suffixes: str) -> DataFrame:
    """``(file_path, content, error)`` of the files below ``root`` whose names end in one of
    the comma-separated ``suffixes``; no folder is skipped for such suffixes."""
    spark.dataSource.register(SourceListing)
    listing = spark.read.format("source_listing").option("suffixes", suffixes).load(root)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_files(listing.repartition(tasks, "file_path"), root)


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """Text of every listed file; one that cannot be read has ``error`` and no content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(root)
        schema = pa.schema([(c, pa.string()) for c in ("file_path", "content", "error")])
        rows: list[dict] = []
        size = 0
        for path in (p for batch in batches for p in batch.column("file_path").to_pylist()):
            content = error = None
            try:
                with filesystem.open_input_stream(base + path) as f:
                    data = f.read()
                content = data.decode("utf-8", "replace")
                size += len(data)
            except OSError as e:
                error = str(e)
            rows.append({"file_path": path, "content": content, "error": error})
            if size > _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return listing.select("file_path").mapInArrow(read, SCHEMA)


def scan_sources(
    spark: SparkSession, root: str, kind: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Files below ``root``; ``kind`` is py, sql, py_sql or None for all.

    Paths are shuffled (not texts), so one big folder is read by many tasks. Their
    number is a setting, not left to run-time sizes, which only see the paths.
    """
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_files(list_sources(spark, root, kind).repartition(tasks, "file_path"), root)


def in_memory(spark: SparkSession, content: str, file_path: str = "<source>") -> DataFrame:
    """One text as a table, under a placeholder path."""
    return spark.createDataFrame([(file_path, content)], "file_path string, content string")


def read_errors(files: DataFrame) -> DataFrame:
    return files.filter(F.col("error").isNotNull()).select("file_path", "error")


def land_sources(files: DataFrame, table_dir: str, commit: str | Column) -> None:
    """Write a scanned tree as Parquet, one partition per commit.

    A second run replaces the commit. With ``commit`` as a text that holds for an empty tree
    too; a column names the commits to replace by its rows.
    """
    if isinstance(commit, str) and commit:
        files.write.mode("overwrite").parquet(
            partition_path(files.sparkSession, table_dir, "commit", commit)
        )
        return
    value = commit if isinstance(commit, Column) else F.lit(commit)
    (
        files.withColumn("commit", value.cast("string"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("commit")
        .parquet(table_dir)
    )


def read_landed(
    spark: SparkSession, table_dir: str, commits: list[str] | None = None
) -> DataFrame:
    """Landed files of the named commits, whose folders alone are listed; of all without names."""
    if commits is not None:
        return read_partitions(spark, table_dir, LANDED_SCHEMA, "commit", commits)
    return spark.read.schema(LANDED_SCHEMA).parquet(table_dir)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row's ``content`` to ``root/file_path``; one ``(file_path, n_bytes)`` per file.

    Writing the same file twice leaves the same bytes, so a task may be repeated.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(root)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("file_path", "content"))):
                target = base + path
                folder = target.rpartition("/")[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                data = content.encode("utf-8")
                with filesystem.open_output_stream(target) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_path"), pa.array(sizes, pa.int64())], ["file_path", "n_bytes"]
            )

    return files.select("file_path", "content").mapInArrow(write, "file_path string, n_bytes long")
