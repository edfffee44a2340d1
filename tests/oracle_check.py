"""Run registered queries against DuckDB: ``python tests/oracle_check.py DIR [query …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(rows: list[tuple], columns: list[str]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if both sides agree, else a short account of the first difference."""
    df = entry.queries()[name](spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = normal(cursor.fetchall(), columns)
    if got[0] != want[0]:
        return f"columns {got[0]} <> {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = list(set(got[1]) - set(want[1]))[:3], list(set(want[1]) - set(got[1]))[:3]
        return f"rows {len(got[1])} <> {len(want[1])}: {extra}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"first difference\n  spark  {a}\n  duckdb {b}"
    if not got[1]:
        return "no rows"
    return None


if __name__ == "__main__":
    from corpusrules.session import build_session

    session = build_session("oracles", "local[8]")
    session.sparkContext.setLogLevel("ERROR")
    folder, *names = sys.argv[1:]
    connection = duck(folder)
    for query in names or list(entry.queries()):
        start = time.time()
        try:
            problem = compare(session, connection, query, folder)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{query:22} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
