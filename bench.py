"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusrules.plans.catalog import QUERIES  # noqa: E402
from corpusrules.session import build_session  # noqa: E402

HEADLINE = (
    "sql_statements",
    "sql_table_usage",
    "embedded_sql_blocks",
    "py_functions",
    "unit_labels",
    "document_labels",
    "label_counts",
    "changes",
    "change_report",
    "function_pages",
    "sql_pages",
    "category_index",
    "overview",
    "quick_links",
    "push_admission",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "headline queries, best of runs, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rpartition("sf")[2],
        "cpus": int(cpus),
        "rates": rates(sf_dir, seconds),
    }
    print(json.dumps(result))


def rates(sf_dir: str, seconds: dict[str, float]) -> dict[str, float]:
    """Units per second; one unit per row of the table behind a query, about."""
    import pyarrow.parquet as pq

    per_second = {}
    for query, name, unit in (
        ("sql_statements", "orders", "statements_per_sec"),
        ("py_functions", "part", "functions_per_sec"),
        ("document_labels", "documents", "documents_per_sec"),
        ("push_admission", "events", "events_per_sec"),
    ):
        if query in seconds:
            rows = pq.ParquetFile(f"{sf_dir}/{name}.parquet").metadata.num_rows
            per_second[unit] = round(rows / seconds[query])
    return per_second


if __name__ == "__main__":
    main()
