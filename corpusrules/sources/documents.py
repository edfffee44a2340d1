"""Sinks for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import INDEX_ORDER, PAGE_ORDER


def write_pages(page_rows: DataFrame, folder: str) -> None:
    """One text file per page, as ``category=…/md_path=…/part-….txt``.

    Chunks of a page go to one task in order and are streamed into the file.
    """
    (
        page_rows.repartition("category", "md_path")
        .sortWithinPartitions(*PAGE_ORDER)
        .select("category", "md_path", "body")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("category", "md_path")
        .text(folder)
    )


def write_page_table(page_rows: DataFrame, folder: str) -> None:
    """Pages as Parquet; the form for corpora with very many files."""
    page_rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "category"
    ).parquet(folder)


def write_lines(lines: DataFrame, order: tuple[str, ...], folder: str) -> None:
    """A document given as lines: part files that read in name order are the document.

    The sort is a range shuffle over all tasks, so no task holds the whole document.
    """
    (
        lines.orderBy(*order)
        .select(F.col("line").alias("value"))
        .write.mode("overwrite")
        .text(folder)
    )


def write_index(lines: DataFrame, folder: str) -> None:
    """Category indexes, one folder of ordered part files per category."""
    (
        lines.repartitionByRange(*INDEX_ORDER)
        .sortWithinPartitions(*INDEX_ORDER)
        .select("category", F.col("line").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("category")
        .text(folder)
    )
