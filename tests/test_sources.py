"""Trees of files, landing, and the whole batch run."""

import datetime
import os

import pytest

from corpusrules.operators.py_units import functions
from corpusrules.operators.sql_units import sql_blocks
from corpusrules.operators.units import extract_units
from corpusrules.plans.batch import run_batch
from corpusrules.sources import files as S


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    contents = {
        "a.py": b"def a(): pass\n",
        "pkg/__init__.py": b"def init(): pass\n",
        "_private/m.py": b"def m(): pass\n",
        "q.sql": b"SELECT 1 FROM t;\n",
        "venv/x.py": b"def x(): pass\n",
        "venv/x.sql": b"SELECT 2;\n",
        "deep/.venv/x.py": b"",
        "deep/__pycache__/x.py": b"",
        "deep/__pycache__/y.sql": b"SELECT 3;\n",
        "node_modules/x.py": b"",
        "node_modules/x.sql": b"",
        ".hidden/x.sql": b"",
        ".x.py": b"",
        "bad.sql": b"-- \xff\xfe\nSELECT 4;",
        "other.txt": b"",
    }
    for path, data in contents.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    return root


def paths(df):
    return sorted(r.file_path for r in df.select("file_path").collect())


def test_scan(spark, tree):
    py = ["_private/m.py", "a.py", "pkg/__init__.py"]
    sql = ["bad.sql", "deep/__pycache__/y.sql", "q.sql", "venv/x.sql"]
    assert paths(S.scan_sources(spark, str(tree), "py")) == py
    assert paths(S.scan_sources(spark, str(tree), "py_sql")) == py
    assert paths(S.scan_sources(spark, str(tree), "sql")) == sql
    assert paths(S.scan_sources(spark, str(tree))) == sorted(py + sql)
    assert paths(S.scan_sources(spark, tree.as_uri())) == sorted(py + sql)


def test_bad_bytes_become_replacement_characters(spark, tree):
    row = S.scan_sources(spark, str(tree), "sql").filter("file_path = 'bad.sql'").first()
    assert row.content == "-- ��\nSELECT 4;"


def test_unreadable_file_is_an_error_row(spark, tree):
    os.symlink(tree / "nowhere", tree / "broken.sql")
    if os.geteuid() != 0:
        (tree / "q.sql").chmod(0)
    files = S.scan_sources(spark, str(tree), "sql")
    assert "venv/x.sql" in paths(files)
    for e in S.read_errors(files).collect():
        assert e.error


def test_read_failure(spark, tree):
    listing = spark.createDataFrame([("q.sql",), ("missing.sql",)], "file_path string")
    rows = {r.file_path: r for r in S.read_files(listing, str(tree)).collect()}
    assert rows["q.sql"].content == "SELECT 1 FROM t;\n" and rows["q.sql"].error is None
    assert rows["missing.sql"].content is None and "missing.sql" in rows["missing.sql"].error


@pytest.mark.parametrize("tasks", [1, 2, 3, 100])
def test_listing_is_whole_however_it_is_cut(tree, monkeypatch, tasks):
    monkeypatch.setattr(S, "_LISTING_TASKS", tasks)
    reader = S._ListingReader(str(tree), (".py", ".sql"), {".py": ("venv",), ".sql": ()})
    found = sorted(path for part in reader.partitions() for path, _ in reader.read(part))
    assert len(found) == len(set(found))
    assert "venv/x.sql" in found and "venv/x.py" not in found and "_private/m.py" in found
    assert len(found) == 10


def test_empty_tree(spark, tmp_path):
    assert S.scan_sources(spark, str(tmp_path)).count() == 0


def test_operators_take_a_scan_as_it_is(spark, tree):
    files = S.scan_sources(spark, str(tree), partitions=3)
    assert files.rdd.getNumPartitions() == 3
    assert {f.name for f in functions(files.filter("file_path like '%.py'")).collect()} == {"a", "init", "m"}
    assert "error" not in sql_blocks(files).columns


def test_in_memory(spark):
    (f,) = functions(S.in_memory(spark, "def f(): pass")).collect()
    assert f.file_path == "<source>"


def test_written_tree_reads_back(spark, files, tmp_path):
    df = files({"x/_a.py": "def f(): pass\n", "y.sql": "SELECT 'é';"})
    sizes = {r.file_path: r.n_bytes for r in S.write_files(df, str(tmp_path / "t")).collect()}
    assert sizes == {"x/_a.py": 14, "y.sql": 12}
    back = S.scan_sources(spark, str(tmp_path / "t"))
    assert {(r.file_path, r.content) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_landing_replaces_one_commit(spark, tree, tmp_path):
    table = str(tmp_path / "landed")
    files = S.scan_sources(spark, str(tree))
    S.land_sources(files, table, "one")
    S.land_sources(files, table, "two")
    S.land_sources(files.filter("file_path = 'a.py'"), table, "two")
    landed = S.read_landed(spark, table)
    assert landed.filter("commit = 'one'").count() == 7
    assert landed.filter("commit = 'two'").count() == 1
    names = {u.name for u in extract_units(landed.filter("commit = 'one'")).collect()}
    assert {"a", "init", "m", "unnamed_query"} == names


def test_run_batch(spark, tree, tmp_path):
    out, table = str(tmp_path / "out"), str(tmp_path / "history")
    t = datetime.datetime(2024, 1, 1)
    first = run_batch(spark, str(tree), out, table, commit="c1", run_ts=t, repo_url="https://h/r")
    assert first is None
    (tree / "a.py").write_text("def a():\n    return threshold\n")
    (tree / "q.sql").unlink()
    (tree / "new.sql").write_text("-- name: fresh\nSELECT 1;")
    (tree / "bad.py").write_text("def ok(): pass\ndef (\n")
    second = run_batch(
        spark, str(tree), out, table, commit="c2", run_ts=t + datetime.timedelta(days=1)
    )
    assert {r.change: r.n for r in second.collect()} == {
        "added": 2,
        "removed": 1,
        "modified": 1,
        "reclassified": 1,
    }
    page = tmp_path / "out/pages/category=business-logic/md_path=a.md"
    assert "## a" in "".join(p.read_text() for p in page.glob("part-*"))
    report = "".join(p.read_text() for p in sorted((tmp_path / "out/changes").glob("part-*")))
    assert "- `fresh` in `new.sql` (pipeline_code)" in report
    (error,) = spark.read.parquet(f"{out}/_tables/errors/run_id=c2").collect()
    assert (error.file_path, error.step) == ("bad.py", "parse")
    # a run that is repeated gives the same counts
    again = run_batch(
        spark, str(tree), out, table, commit="c2", run_ts=t + datetime.timedelta(days=1)
    )
    assert sorted(again.collect()) == sorted(second.collect())


def test_links_to_folders_are_not_entered(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("")
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    os.symlink(tmp_path / "a" / "x.py", tmp_path / "a" / "y.py")
    assert paths(S.list_sources(spark, str(tmp_path))) == ["a/x.py", "a/y.py"]


def test_folder_that_fails_is_an_error_row(monkeypatch, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "a.py").write_text("")
    reader = S._ListingReader(str(tmp_path), (".py",), {".py": ()})
    plain = S.fs.FileSelector

    def selector(path):
        if path.endswith("bad"):
            raise PermissionError(path)
        return plain(path)

    monkeypatch.setattr(S.fs, "FileSelector", selector)
    found = [row for part in reader.partitions() for row in reader.read(part)]
    assert sorted(found) == [("a.py", 0), ("bad", 0)]


def test_reading_a_listed_folder_is_an_error(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    listed = spark.createDataFrame([("bad", 0)], "file_path string, n_bytes long")
    row = S.read_files(listed, str(tmp_path)).first()
    assert row.file_path == "bad" and row.content is None and row.error


def test_landing_an_empty_tree_replaces(spark, tree, tmp_path):
    files, table = S.scan_sources(spark, str(tree)), str(tmp_path / "landed")
    S.land_sources(files, table, "one")
    S.land_sources(files.limit(0), table, "one")
    assert S.read_landed(spark, table).count() == 0
    S.land_sources(files, table, "one")
    assert {r.commit for r in S.read_landed(spark, table).collect()} == {"one"}
