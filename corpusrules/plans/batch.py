"""One whole run: scan, extract, label, compare with the last run, report, keep."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports as R
from ..operators.changes import REPORT_ORDER, change_counts, change_report, changes, snapshot
from ..operators.classify import classify
from ..operators.py_units import parse_functions
from ..operators.units import extract_units, file_errors, python_files
from ..sources import documents as D
from ..sources.files import land_sources, read_landed, scan_sources
from ..sources.snapshots import latest_snapshot, one_run, write_snapshot


def run_batch(
    spark: SparkSession,
    root: str,
    out_dir: str,
    snapshot_table: str,
    repo_url: str | None = None,
    ambiguous: Callable[[str], str] | None = None,
    commit: str | None = None,
    run_ts: datetime.datetime | None = None,
    page_files: bool = True,
) -> DataFrame | None:
    """Run all steps in order; the result is the change counts, or None on a first run.

    The scanned tree and the labelled units are each written once and read back,
    so nothing is parsed or asked twice. ``page_files`` False keeps the pages as
    one table instead of one file per page.
    """
    run_ts = run_ts or datetime.datetime.now(datetime.timezone.utc)
    run_id = commit or run_ts.strftime("%Y%m%dT%H%M%S%f")

    land_sources(scan_sources(spark, root), f"{out_dir}/_tables/source_files", run_id)
    files = read_landed(spark, f"{out_dir}/_tables/source_files", [run_id])

    def table(df: DataFrame, name: str) -> DataFrame:
        path = f"{out_dir}/_tables/{name}/run_id={run_id}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    # a file that fails is noted and the run goes on
    parsed = table(parse_functions(python_files(files)), "parsed")
    table(file_errors(files, parsed), "errors")
    units = table(classify(extract_units(files, parsed=parsed), ambiguous), "units")

    # the previous run has to be read before this one is added
    previous = latest_snapshot(spark, snapshot_table, before=run_ts)
    current = snapshot(units, run_id, run_ts, commit)
    changed = table(changes(previous, current), "changes")

    generated = run_ts.isoformat()
    D.write_lines(change_report(changed, generated), REPORT_ORDER, f"{out_dir}/changes")
    page_rows = R.pages(units, repo_url)
    (D.write_pages if page_files else D.write_page_table)(page_rows, f"{out_dir}/pages")
    D.write_index(R.category_index(units), f"{out_dir}/categories")
    D.write_lines(R.overview_page(units, generated), ("part", "ordinal"), f"{out_dir}/index")

    write_snapshot(current, snapshot_table, one_run(spark, run_id, run_ts, commit))
    return change_counts(changed) if previous is not None else None
