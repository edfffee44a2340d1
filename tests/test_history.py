"""History by write ids: a write stopped at any step leaves the previous result readable."""

import datetime
import os

from pyspark.sql import functions as F

from corpusrules.sources import snapshots as S

COLUMNS = S.ROW_SCHEMA


def rows(spark, run_id, names, ts=1):
    data = [
        (datetime.datetime(2024, 1, ts), f"c{ts}", "sql", "f.sql", n, i, None, "query", "pipeline_code", f"h{n}", run_id)
        for i, n in enumerate(names)
    ]
    return spark.createDataFrame(data, COLUMNS)


def names(spark, table, run=None):
    got = S.read_rows(spark, table, None if run is None else [run])
    return sorted((r.run_id, r.name) for r in got.collect())


def test_stops_between_steps(spark, tmp_path):
    table = str(tmp_path / "h")
    run1 = S.one_run(spark, "r1", datetime.datetime(2024, 1, 1), "c1")
    S.write_snapshot(rows(spark, "r1", ["a", "b"]), table, run1)
    assert names(spark, table) == [("r1", "a"), ("r1", "b")]

    later = S.new_write_id()
    S.write_rows(rows(spark, "r1", ["x"]), table, later)  # stopped before its entry
    assert names(spark, table) == [("r1", "a"), ("r1", "b")]
    assert S.latest_run(spark, table) == "r1"

    S.publish(spark, table, run1, later)
    assert names(spark, table) == [("r1", "x")]
    entry = S.entries(spark, table).collect()
    assert len(entry) == 1 and entry[0].units == 1

    S.compact(spark, table)
    assert names(spark, table) == [("r1", "x")]
    kept = os.listdir(f"{table}/rows/run_id=r1")
    assert kept == [f"write_id={later}"]  # the replaced version is gone
    assert len([p for p in os.listdir(f"{table}/runs") if p.startswith("published=")]) == 1


def test_replaced_by_nothing_and_latest(spark, tmp_path):
    table = str(tmp_path / "h")
    for ts, run in ((1, "r1"), (2, "r2")):
        S.write_snapshot(rows(spark, run, ["a"], ts), table, S.one_run(spark, run, datetime.datetime(2024, 1, ts)))
    empty = rows(spark, "r2", []).where(F.lit(False))
    S.write_snapshot(empty, table, S.one_run(spark, "r2", datetime.datetime(2024, 1, 2)))
    assert names(spark, table) == [("r1", "a")]
    assert S.latest_run(spark, table) == "r2"  # a finished run of no units
    assert S.latest_snapshot(spark, table).count() == 0
    assert S.latest_run(spark, table, before=datetime.datetime(2024, 1, 2)) == "r1"


def test_list_of_runs_stays_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "COMPACT_AFTER", 3)
    table = str(tmp_path / "h")
    for i in range(8):
        run = f"r{i % 3}"
        S.write_snapshot(rows(spark, run, [f"n{i}"]), table, S.one_run(spark, run, datetime.datetime(2024, 1, 1 + i)))
    assert len(os.listdir(f"{table}/runs")) <= 4
    assert names(spark, table) == [("r0", "n6"), ("r1", "n7"), ("r2", "n5")]


def test_missing_history(spark, tmp_path):
    table = str(tmp_path / "none")
    assert S.latest_snapshot(spark, table) is None
    assert S.read_rows(spark, table).count() == 0


def test_batch_history_labels_each_version_once(spark, tmp_path, monkeypatch):
    from corpusrules.plans import catalog

    labelled, plain = [], catalog._snapshot

    def snapshot(spark, sf_dir, version):
        labelled.append(version)
        return plain(spark, sf_dir, version)

    monkeypatch.setattr(catalog, "_snapshot", snapshot)
    monkeypatch.setattr(catalog, "shared_dir", lambda spark: str(tmp_path))
    got = catalog.batch_history(spark, "/root/testdata/sf0.001").collect()
    assert sorted(labelled) == [1, 2]
    assert {r.run_id for r in got} == {"run1", "run2"} and all(r.n > 0 for r in got)
    assert [n.split("-")[0] for n in os.listdir(tmp_path)] == ["history"]  # the kept rows are gone
