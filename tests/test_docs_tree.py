"""The docs tree sink: whole files in order, links that resolve, nothing left by a failed job."""

import hashlib
import os
import re
import tarfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from corpusrules.operators import reports as R
from corpusrules.operators.classify import classify
from corpusrules.operators.units import extract_units
from corpusrules.sources import docs_tree
from corpusrules.sources.docs_tree import read_archives, write_tree

SOURCES = {
    "app/rules.py": 'def price(x):\n    """Discount rule."""\n    # BUSINESS_RULE: cap at 10\n    return min(x, 10)\n\n'
    'def load(path):\n    return open(path).read()\n\nQUERY = """SELECT a FROM orders WHERE a > 5"""\n',
    "app-rules.py": "def other(a):\n    return a\n",
    "sql/report.sql": "-- name: totals\nSELECT SUM(a) AS s FROM sales;\nCREATE VIEW v AS SELECT * FROM t;\n",
    "README.py": "def readme():\n    return 1\n",
}


def tree(root):
    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            out[os.path.relpath(path, root)] = open(path, encoding="utf-8").read()
    return out


@pytest.fixture(scope="module")
def units(spark, files):
    return classify(extract_units(files(SOURCES)))


def test_lines_in_order_and_replaced_whole(spark, tmp_path):
    rows = [("a/x.md", 0, "", i, f"line {i}") for i in range(2500)] + [("b.md", 1, "k", 0, None)]
    lines = spark.createDataFrame(rows, "path string, a long, b string, c long, line string")
    folder = str(tmp_path / "t")
    write_tree(lines.repartition(5), folder)  # rows arrive in any order
    got = tree(folder)
    assert got == {"a/x.md": "".join(f"line {i}\n" for i in range(2500)), "b.md": "\n"}
    write_tree(lines.where("path = 'b.md'"), folder)
    assert tree(folder) == {"b.md": "\n"}  # the old tree is replaced, not merged
    assert os.listdir(tmp_path) == ["t"]  # no staging folder is left


def test_failed_job_leaves_old_tree(spark, tmp_path):
    folder = str(tmp_path / "t")
    good = spark.createDataFrame([("x.md", 0, "", 0, "old")], "path string, a long, b string, c long, line string")
    write_tree(good, folder)
    bad = spark.range(100).select(
        F.concat(F.lit("p"), (F.col("id") % 7).cast("string"), F.lit(".md")).alias("path"),
        F.col("id").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c"),
        F.when(F.col("id") == 97, F.raise_error(F.lit("boom"))).otherwise(F.lit("new")).alias("line"),
    )
    with pytest.raises(Exception):
        write_tree(bad, folder, tasks=4)
    assert tree(folder) == {"x.md": "old\n"}
    assert os.listdir(tmp_path) == ["t"]


def test_tree_links_resolve_and_collisions(spark, units, tmp_path):
    folder = str(tmp_path / "docs")
    write_tree(R.tree_lines(units, "https://repo", "2024-01-01"), folder)
    got = tree(folder)
    assert "index.md" in got
    assert {p for p in got if p.endswith("README.md")} >= {"business-logic/README.md"}
    for path, text in got.items():
        here = os.path.dirname(path)
        for target in re.findall(r"\]\(\./([^)#]*)", text):
            full = os.path.normpath(os.path.join(folder, here, target))
            assert os.path.exists(full), (path, target)
    # app/rules.py and app-rules.py both map to app-rules.md; rules.py's SQL page replaces its
    # function page and the later path wins among pages of one kind
    candidates = {}
    for r in R.pages(units, "https://repo").select("category", "md_path", "kind", "file_path").collect():
        key = f"{r.category}/{r.md_path}"
        candidates[key] = max(candidates.get(key, (-1, "")), (r.kind == "sql", r.file_path))
    for key, (_, file_path) in candidates.items():
        if key.endswith("/README.md"):
            continue
        assert f"**File:** `{file_path}`" in got[key]
    assert "business-logic/app-rules.md" in got or "pipeline-code/app-rules.md" in got
    # a file named README.py does not replace the category index
    readme = [t for p, t in got.items() if p.endswith("/README.md")]
    assert all(t.startswith("# ") and "Documentation" in t.splitlines()[0] for t in readme)


def test_tree_lines_match_the_documents(spark, units):
    lines = R.tree_lines(units, None, "g").collect()
    paths = {r.path for r in lines}
    assert "index.md" in paths
    index = sorted((r.a, r.c, r.line) for r in lines if r.path == "index.md")
    want = sorted((r.part, r.ordinal, r.line) for r in R.overview_page(units, "g").collect())
    assert index == want


def test_archives_hold_the_tree_in_few_files(spark, units, tmp_path):
    lines = R.tree_lines(units, "https://repo", "2024-01-01")
    write_tree(lines, str(tmp_path / "files"))
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "old.md").write_text("old")
    write_tree(lines, str(folder), tasks=2, archives=True)
    assert len(os.listdir(folder)) <= 2 and all(n.endswith(".tar.gz") for n in os.listdir(folder))
    got = read_archives(spark, str(folder)).collect()
    assert {r.file_path: r.content for r in got} == tree(tmp_path / "files")
    assert len(got) == len({r.file_path for r in got}) and all(r.error is None for r in got)
    for name in os.listdir(folder):  # unpacked, the archives are the tree
        tarfile.open(folder / name).extractall(tmp_path / "unpacked", filter="data")
    assert tree(tmp_path / "unpacked") == tree(tmp_path / "files")
    (folder / "z.tar.gz").write_bytes(b"broken")
    assert [r.file_path for r in read_archives(spark, str(folder)).where("error is not null").collect()] == ["z.tar.gz"]


def test_archives_begin_anew(tmp_path, monkeypatch):
    monkeypatch.setattr(docs_tree, "DOCUMENTS_PER_ARCHIVE", 2)
    target = docs_tree._Archives(pafs.LocalFileSystem(), str(tmp_path / "a"), 3)
    for i in range(5):
        out = target.open(f"p/{i}.md")
        out.write(b"x" * i)
        out.close()
    target.close()
    found = [tarfile.open(tmp_path / "a" / n).getnames() for n in sorted(os.listdir(tmp_path / "a"))]
    assert found == [["p/0.md", "p/1.md"], ["p/2.md", "p/3.md"], ["p/4.md"]]


def test_written_docs_keeps_short_documents_in_archives(spark, tmp_path, monkeypatch):
    from corpusrules.plans import catalog

    monkeypatch.setattr(catalog, "shared_dir", lambda spark: str(tmp_path))
    n = catalog.written_docs(spark, "/root/testdata/sf0.001").count()
    files = [name for folder, _, names in os.walk(tmp_path) for name in names if "/tree" in folder]
    assert n > 100 * len(files) and files


def test_facts_of_archived_documents(spark, tmp_path):
    """Documents of any length and name, read back a piece at a time."""
    long_path, text = "a/" + "x" * 150 + ".md", "é" * 700_000
    rows = [(long_path, 0, "", i, text) for i in range(2)]
    rows += [("ü/y.md", 1, "", 0, None), ("ü/y.md", 0, "", 0, "one\ntwo"), ("z.md", 0, "", 0, "")]
    lines = spark.createDataFrame(rows, "path string, a long, b string, c long, line string")
    write_tree(lines, str(tmp_path / "t"), archives=True)
    want = {long_path: f"{text}\n{text}\n", "ü/y.md": "one\ntwo\n\n", "z.md": "\n"}
    assert {r.file_path: r.content for r in read_archives(spark, str(tmp_path / "t")).collect()} == want
    (tmp_path / "t" / "z.tar.gz").write_bytes((tmp_path / "t" / os.listdir(tmp_path / "t")[0]).read_bytes()[:-9])
    got = {tuple(r) for r in read_archives(spark, str(tmp_path / "t"), facts=True).collect() if r.error is None}
    assert got == {(p, t.count("\n"), hashlib.md5(t.encode()).hexdigest(), None) for p, t in want.items()}
    broken = read_archives(spark, str(tmp_path / "t"), facts=True).where("error is not null").collect()
    assert [tuple(r)[:3] for r in broken] == [("z.tar.gz", None, None)]


def test_long_documents_go_through_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(docs_tree, "_BATCH_BYTES", 10)
    target = docs_tree._Archives(pafs.LocalFileSystem(), str(tmp_path / "a"), 0)
    for path in ("long.md", "s.md"):
        out = target.open(path)
        for part in (b"12345678", b"9abc", b"", b"de")[: None if path == "long.md" else 1]:
            out.write(part)
        out.close()
    target.close()
    with open(tmp_path / "a" / "docs-00000-00000.tar.gz", "rb") as f:
        got = {name: b"".join(pieces) for name, pieces in docs_tree._members(f)}
    assert got == {"long.md": b"123456789abcde", "s.md": b"12345678"}
    with tarfile.open(tmp_path / "a" / "docs-00000-00000.tar.gz") as tar:
        assert tar.extractfile("long.md").read() == got["long.md"]


def test_runs_of_one_path_in_a_batch():
    import pyarrow as pa

    rows = [("a", "x"), ("a", None), ("b", "é"), ("c", ""), ("a", "y")]
    batch = pa.RecordBatch.from_pylist(
        [{"path": "gone", "a": 0, "b": "", "c": 0, "line": "gone"}]
        + [{"path": p, "a": 0, "b": "", "c": 0, "line": t} for p, t in rows]
    ).slice(1)
    assert list(docs_tree._runs(batch)) == [("a", b"x\n\n"), ("b", "é\n".encode()), ("c", b"\n"), ("a", b"y\n")]
    assert list(docs_tree._runs(batch.slice(0, 0))) == []
