"""Push events and the runs they start."""

import datetime
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from corpusrules.sources.files import SCHEMA, land_sources, read_landed
from corpusrules.sources.snapshots import read_rows
from corpusrules.streaming import events as E

SECRET = "s3cret"


def sign(body, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


@pytest.fixture(scope="module")
def handle(spark):
    def run(secret=SECRET, **e):
        e = {"event": "push", "method": "POST", "url": "/webhook", "body": "{}"} | e
        e.setdefault("signature", sign(e["body"]))
        row = (1, datetime.datetime(2024, 1, 1), e["event"], e["method"], e["url"], e["signature"], e["body"])
        return E.handle_events(spark.createDataFrame([row], E.EVENT_SCHEMA), secret).first()

    return run


@pytest.mark.parametrize("secret", ["k", "x" * 64, "y" * 100, "ключ"])
def test_hmac(spark, secret):
    bodies = ["", "a", "é\n" * 500]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [r[0] for r in df.select(E.hmac_sha256(secret, F.col("b"))).collect()]
    assert got == [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]


@pytest.mark.parametrize(
    "change, status",
    [
        ({}, 200),
        ({"url": "/"}, 200),
        ({"method": "GET"}, 405),
        ({"method": None}, 405),
        ({"method": "GET", "url": "/x"}, 405),
        ({"url": "/x", "signature": None}, 404),
        ({"url": None}, 404),
        ({"signature": None}, 401),
        ({"signature": "short"}, 401),
        ({"signature": sign("{} ")}, 401),
        ({"body": "{bad", "signature": "x"}, 401),
        ({"body": "{bad"}, 400),
        ({"body": ""}, 400),
        ({"body": "{} x"}, 400),
        ({"body": "{}, {}"}, 400),
        ({"body": "{'ref': 'x'}"}, 400),
        ({"body": "[1]"}, 200),
        ({"body": " 5 "}, 200),
        ({"body": '{"ref": "a", "ref": "b"}'}, 200),
        ({"event": "other"}, 200),
        ({"event": None}, 200),
    ],
)
def test_status(handle, change, status):
    assert handle(**change).status == status


def test_without_secret_everything_passes(handle):
    assert handle(secret=None, signature=None).status == 200
    assert handle(secret="", signature="x").status == 200


def routed(r):
    return r.action, r.ref, r.commit, r.message


def test_push_defaults(handle):
    assert routed(handle()) == ("run", "refs/heads/main", "unknown", "No message")
    empty = json.dumps({"ref": "", "head_commit": {"id": "", "message": ""}})
    assert routed(handle(body=empty)) == ("run", "refs/heads/main", "unknown", "No message")


@pytest.mark.parametrize("ref, action", [("main", "run"), ("master", "run"), ("dev", "ignore")])
def test_push_branches(handle, ref, action):
    body = json.dumps({"ref": f"refs/heads/{ref}", "head_commit": {"id": "c1", "message": "m"}})
    assert routed(handle(body=body)) == (action, f"refs/heads/{ref}", "c1", "m")


def test_dispatch(handle):
    assert routed(handle(event="repository_dispatch")) == ("run", "main", "unknown", "Dispatch trigger")
    body = json.dumps({"client_payload": {"ref": "dev", "commit_sha": "c2", "commit_message": "go"}})
    assert routed(handle(event="repository_dispatch", body=body)) == ("run", "dev", "c2", "go")


def test_other_events_do_nothing(handle):
    for event in ("ping", "issues", None):
        assert routed(handle(event=event)) == ("ignore", None, None, None)
    assert routed(handle(method="GET")) == (None, None, None, None)


# --- stream ----------------------------------------------------------------------------------


def write_events(folder, name, events):
    folder.mkdir(exist_ok=True)
    lines = []
    for i, (ts, commit) in enumerate(events):
        body = json.dumps({"head_commit": {"id": commit, "message": "m"}})
        lines.append(
            json.dumps(
                {"event_id": i, "ts": ts, "event": "push", "method": "POST", "url": "/",
                 "signature": sign(body), "body": body}
            )
        )
    (folder / name).write_text("\n".join(lines))


def test_stream(spark, tmp_path):
    trees = {
        "c1": {"a.sql": "-- name: x\nSELECT 1;", "b.py": "def f(): pass"},
        "c2": {"a.sql": "-- name: x\nSELECT kpi;", "b.py": "def f(): pass"},
        "c3": {"a.sql": "-- name: x\nSELECT kpi;"},
        "c4": {"notes.sql": "\n"},
    }
    rows = [(p, t, c) for c, tree in trees.items() for p, t in tree.items()]
    spark.createDataFrame(rows, "file_path string, content string, commit string").write.partitionBy(
        "commit"
    ).parquet(str(tmp_path / "files"))
    table, inbox = str(tmp_path / "history"), tmp_path / "in"

    def run(state="state"):
        stream = E.read_push_events(spark, str(inbox))
        E.run_stream(stream, str(tmp_path / "files"), table, str(tmp_path / state), SECRET).awaitTermination(300)
        found = spark.read.parquet(f"{table}/changes").collect()
        return sorted((r.run_id, r.name, r.change) for r in found)

    day = "2024-01-0{}T00:00:00.000Z".format
    # two commits in one batch, one of them pushed twice, and one without files
    write_events(inbox, "1.json", [(day(1), "c1"), (day(2), "c2"), (day(2), "c2"), (day(2), "none")])
    expected = [
        ("c1", "f", "added"),
        ("c1", "x", "added"),
        ("c2", "x", "modified"),
        ("c2", "x", "reclassified"),
    ]
    assert run() == expected
    # the next batch compares with the last run of the batch before; c4 has no unit at all
    write_events(inbox, "2.json", [(day(3), "c3"), (day(4), "c4")])
    expected += [("c3", "f", "removed"), ("c4", "x", "removed")]
    assert run() == expected
    # a lost checkpoint replays every event; nothing changes
    assert run("other") == expected
    assert read_rows(spark, table).count() == 5


def test_stream_keeps_units_and_asks_about_ties(spark, tmp_path):
    rows = [("a.sql", "SELECT 1;\nSELECT kpi;", "c1")]
    spark.createDataFrame(rows, "file_path string, content string, commit string").write.partitionBy(
        "commit"
    ).parquet(str(tmp_path / "files"))
    write_events(tmp_path / "in", "1.json", [("2024-01-01T00:00:00.000Z", "c1")])
    E.run_stream(
        E.read_push_events(spark, str(tmp_path / "in")), str(tmp_path / "files"), str(tmp_path / "h"),
        str(tmp_path / "state"), SECRET, units_table=str(tmp_path / "units"),
        ambiguous=lambda _: '{"classification": "business_logic", "reason": "asked"}',
    ).awaitTermination(300)
    units = spark.read.parquet(str(tmp_path / "units")).orderBy("ordinal").collect()
    assert [(u.source_code, u.reason) for u in units] == [
        ("SELECT 1;", "AI: asked"),
        ("SELECT kpi;", "Matches 1 business logic patterns"),
    ]
    assert {r.classification for r in read_rows(spark, str(tmp_path / "h")).collect()} == {"business_logic"}


def test_events_without_time_run_at_the_time_of_the_batch(spark, tmp_path):
    rows = [("a.sql", "SELECT 1;", "c1")]
    spark.createDataFrame(rows, "file_path string, content string, commit string").write.partitionBy(
        "commit"
    ).parquet(str(tmp_path / "files"))
    body = json.dumps({"ref": "refs/heads/main", "head_commit": {"id": "c1"}})
    row = (1, "push", "POST", "/", sign(body), body)
    schema = "event_id long, event string, method string, url string, signature string, body string"
    batch = spark.createDataFrame([row], schema)
    E.run_batch_of_events(batch, str(tmp_path / "files"), str(tmp_path / "h"), SECRET)
    (found,) = read_rows(spark, str(tmp_path / "h")).collect()
    assert found.run_id == "c1" and found.run_ts is not None


def land(spark, folder, trees):
    rows = [(p, t, c) for c, tree in trees.items() for p, t in tree.items()]
    files = spark.createDataFrame(rows, "file_path string, content string, commit string")
    files.write.mode("append").partitionBy("commit").parquet(str(folder))


def batch_of(spark, *events):
    rows = []
    for i, (day, commit) in enumerate(events):
        body = json.dumps({"head_commit": {"id": commit, "message": "m"}})
        ts = datetime.datetime(2024, 1, day)
        rows.append((i, ts, "push", "POST", "/", sign(body), body))
    return spark.createDataFrame(rows, E.EVENT_SCHEMA)


def changed(spark, table):
    return sorted((r.run_id, r.name, r.change) for r in spark.read.parquet(f"{table}/changes").collect())


@pytest.mark.parametrize("size", [1, 500])
def test_runs_are_compared_in_the_order_they_are_done(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(E, "BLOCK", size)
    files, table = str(tmp_path / "files"), str(tmp_path / "h")
    land(spark, files, {c: {"a.py": f"def {c}(): pass"} for c in ("c0", "c1", "c2", "c3")})
    E.run_batch_of_events(batch_of(spark, (1, "c0"), (3, "c2")), files, table, SECRET, batch_key="s#0")
    expected = [("c0", "c0", "added"), ("c2", "c0", "removed"), ("c2", "c2", "added")]
    assert changed(spark, table) == expected
    # c1 comes late: it follows what was done before it; a repeated batch changes nothing
    expected += [
        ("c1", "c1", "added"), ("c1", "c2", "removed"),
        ("c3", "c1", "removed"), ("c3", "c3", "added"),
    ]
    for _ in range(2):
        E.run_batch_of_events(batch_of(spark, (2, "c1"), (4, "c3")), files, table, SECRET, batch_key="s#1")
        assert changed(spark, table) == sorted(expected)


def test_commit_waits_until_it_lands(spark, tmp_path):
    files, table = str(tmp_path / "files"), str(tmp_path / "h")
    land(spark, files, {"c1": {"a.py": "def a(): pass"}})
    E.run_batch_of_events(batch_of(spark, (1, "c1"), (2, "a/b c")), files, table, SECRET)
    assert {r.run_id for r in read_rows(spark, table).collect()} == {"c1"}
    land(spark, files, {"a/b c": {"a.py": "def b(): pass"}})
    for _ in range(2):  # the second time nothing waits any more
        E.run_batch_of_events(batch_of(spark, (3, "x")).limit(0), files, table, SECRET)
        assert changed(spark, table) == [
            ("a/b c", "a", "removed"), ("a/b c", "b", "added"), ("c1", "a", "added"),
        ]


def test_batch_opens_its_own_commits_only(spark, tmp_path):
    files, table = tmp_path / "files", str(tmp_path / "h")
    land(spark, files, {f"c{i}": {"a.py": f"def f{i}(): pass"} for i in range(50)})
    for path in files.rglob("*.parquet"):
        if path.parent.name not in ("commit=c7", "commit=c8"):
            path.write_bytes(b"not to be read")
            (path.parent / f".{path.name}.crc").unlink()
    E.run_batch_of_events(batch_of(spark, (1, "c7"), (2, "c8")), str(files), table, SECRET)
    assert {r.name for r in read_rows(spark, table).collect()} == {"f7", "f8"}
    assert len(read_landed(spark, str(files), ["c7", "c8", "none"]).inputFiles()) == 2


def test_emptied_commit_keeps_nothing(spark, tmp_path):
    files, table = str(tmp_path / "files"), str(tmp_path / "h")
    tree = spark.createDataFrame([("a.py", "def a(): pass", None)], SCHEMA)
    land_sources(tree, files, "c1")
    E.run_batch_of_events(batch_of(spark, (1, "c1")), files, table, SECRET, units_table=f"{table}/units")
    assert read_rows(spark, table).count() == 1
    land_sources(tree.limit(0), files, "c1")
    E.run_batch_of_events(batch_of(spark, (2, "c1")), files, table, SECRET, units_table=f"{table}/units")
    assert read_rows(spark, table).count() == 0
    assert list((tmp_path / "h" / "units").rglob("*.parquet")) == []
