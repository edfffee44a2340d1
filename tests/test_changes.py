"""Snapshots and the differences between them."""

import datetime

import pytest

from corpusrules.operators import changes as H
from corpusrules.sources import snapshots as N

TS = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture(scope="module")
def snap(spark):
    schema = (
        "kind string, file_path string, name string, ordinal int, sql_type string, "
        "classification string, source_code string"
    )

    def make(rows, run_id="r", run_ts=TS):
        units = spark.createDataFrame(
            [(k, p, n, o, "query" if k == "sql" else None, c, s) for k, p, n, o, c, s in rows], schema
        )
        return H.snapshot(units, run_id, run_ts, "c")

    return make


B, P = "business_logic", "pipeline_code"
OLD = [
    ("function", "a.py", "same", 0, B, "1"),
    ("function", "a.py", "edited", 1, B, "1"),
    ("function", "a.py", "gone", 2, B, "1"),
    ("function", "a.py", "moved", 3, B, "1"),
    ("function", "a.py", "both", 4, P, "1"),
    ("sql", "a.py", "twin", 5, P, "1"),
]
NEW = [
    ("function", "a.py", "same", 0, B, "1"),
    ("function", "a.py", "edited", 1, B, "2"),
    ("function", "a.py", "moved", 3, P, "1"),
    ("function", "a.py", "both", 4, B, "2"),
    ("function", "a.py", "twin", 5, P, "1"),
    ("sql", "a.py", "twin", 5, P, "2"),
]


def test_snapshot_hashes_the_source(snap):
    r = snap(OLD).filter("name = 'same'").first()
    assert r.hash == "c4ca4238a0b923820dcc509a6f75849b"
    assert (r.run_id, r.commit, r.run_ts) == ("r", "c", TS)
    assert "source_code" not in r.asDict()


def test_changes(snap):
    found = {
        (c.kind, c.name, c.change): (c.from_class, c.to_class)
        for c in H.changes(snap(OLD), snap(NEW)).collect()
    }
    assert found == {
        ("function", "edited", "modified"): (None, None),
        ("function", "gone", "removed"): (None, None),
        ("function", "moved", "reclassified"): (B, P),
        ("function", "both", "modified"): (None, None),
        ("function", "both", "reclassified"): (P, B),
        ("function", "twin", "added"): (None, None),
        ("sql", "twin", "modified"): (None, None),
    }


def test_change_keeps_both_rows(snap):
    c = H.changes(snap(OLD), snap(NEW)).filter("name = 'edited'").first()
    assert c.prev.hash != c.curr.hash and c.prev.ordinal == c.curr.ordinal == 1


def test_counts_have_all_classes(snap):
    assert [tuple(r) for r in H.change_counts(H.changes(snap(OLD), snap(NEW))).collect()] == [
        ("added", 1),
        ("removed", 1),
        ("modified", 3),
        ("reclassified", 2),
    ]
    same = H.change_counts(H.changes(snap(OLD), snap(OLD))).collect()
    assert [r.n for r in same] == [0, 0, 0, 0]


DOUBLE = [
    ("sql", "a.sql", "unnamed_query", 0, B, "1"),
    ("sql", "a.sql", "x", 1, B, "1"),
    ("sql", "a.sql", "unnamed_query", 2, P, "3"),
]


def test_last_unit_of_a_key_wins(snap):
    rows = H.dedupe_units(snap(DOUBLE)).orderBy("position").collect()
    assert [(r.name, r.position, r.ordinal, r.classification) for r in rows] == [
        ("unnamed_query", 0, 2, P),
        ("x", 1, 1, B),
    ]
    # the first of the two is not looked at
    changed = [(*r[:4], r[4] + "!" if r[3] == 0 else r[4], r[5]) for r in DOUBLE]
    assert H.changes(snap(DOUBLE), snap(changed)).count() == 0


def test_key_with_ordinal_compares_every_unit(snap):
    key = (*H.KEY, "ordinal")
    changed = [(*r[:5], "9") if r[3] == 0 else r for r in DOUBLE]
    (c,) = H.changes(snap(DOUBLE), snap(changed), key).collect()
    assert (c.ordinal, c.change) == (0, "modified")


def test_first_run_is_not_deduplicated(snap):
    rows = H.changes(None, snap(DOUBLE)).collect()
    assert len(rows) == 3 and {r.change for r in rows} == {"added"}
    assert H.changes(snap([OLD[0]]), snap(DOUBLE)).filter("change = 'added'").count() == 2


def test_many_pairs_of_runs_at_once(snap):
    key = ("run_id", *H.KEY)
    prev = snap(OLD, "1").unionByName(snap(NEW, "2"))
    curr = snap(NEW, "1").unionByName(snap(NEW, "2"))
    rows = H.changes(prev, curr, key).collect()
    assert {r.run_id for r in rows} == {"1"} and len(rows) == 7


def test_report(snap):
    report = H.change_report(H.changes(snap(OLD), snap(NEW)), "now")
    lines = [r.line for r in report.orderBy(*H.REPORT_ORDER).collect()]
    assert "\n".join(lines) == (
        "# Documentation Changes Report\n\n**Generated:** now\n\n## Summary\n\n"
        "- ➕ Added: 1\n- ➖ Removed: 1\n- ✏️ Modified: 3\n- 🔄 Reclassified: 2\n\n"
        "## Added Functions\n\n- `twin` in `a.py` (pipeline_code)\n\n"
        "## Removed Functions\n\n- `gone` from `a.py`\n\n"
        "## Modified Functions\n\n- `edited` in `a.py`\n- `both` in `a.py`\n\n"
        "## Modified SQL Blocks\n\n- `twin` in `a.py`\n\n"
        "## Reclassified Items\n\n- `moved` in `a.py`: business_logic → pipeline_code\n"
        "- `both` in `a.py`: pipeline_code → business_logic\n"
    )


# --- history -------------------------------------------------------------------------------


def test_history(spark, snap, tmp_path, caplog):
    table = str(tmp_path / "history")
    assert N.latest_snapshot(spark, table) is None
    assert "no previous snapshot" in caplog.text

    later = TS + datetime.timedelta(hours=1)
    one, two = N.one_run(spark, "one", TS), N.one_run(spark, "two", later, "c")
    N.write_snapshot(snap(OLD, "one", TS), table, one)
    N.write_snapshot(snap(NEW, "two", later), table, two)
    assert N.latest_run(spark, table) == "two"
    assert N.latest_run(spark, table, before=TS + datetime.timedelta(hours=1)) == "one"
    assert N.latest_run(spark, table, before=TS) is None
    latest = N.latest_snapshot(spark, table)
    assert latest.count() == len(NEW)
    assert latest.inputFiles() and all("/run_id=two/" in f for f in latest.inputFiles())

    # the same run again replaces itself and nothing else
    N.write_snapshot(snap(NEW[:2], "two", later), table, two)
    assert N.latest_snapshot(spark, table).count() == 2
    assert N.read_rows(spark, table).count() == len(OLD) + 2


def test_run_without_units_is_a_run(spark, snap, tmp_path):
    table = str(tmp_path / "history")
    N.write_snapshot(snap(OLD, "one", TS), table, N.one_run(spark, "one", TS))
    later = TS + datetime.timedelta(hours=1)
    N.write_snapshot(snap([], "two", later), table, N.one_run(spark, "two", later))
    previous = N.latest_snapshot(spark, table)
    assert N.latest_run(spark, table) == "two" and previous.count() == 0
    # an emptied run keeps none of its old rows
    N.write_snapshot(snap([], "one", TS), table, N.one_run(spark, "one", TS))
    assert N.read_rows(spark, table).count() == 0


def test_unreadable_history_is_a_first_run(spark, snap, tmp_path, caplog):
    table = tmp_path / "history"
    N.write_snapshot(snap(OLD, "one", TS), str(table), N.one_run(spark, "one", TS))
    for f in (table / "runs").rglob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (table / "runs").rglob("*.crc"):
        f.write_bytes(b"")
    assert N.latest_snapshot(spark, str(table)) is None
    assert "no previous snapshot" in caplog.text


def test_one_shuffle_of_narrow_rows(snap):
    plan = H.changes(snap(OLD), snap(NEW))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan
