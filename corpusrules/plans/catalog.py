"""Registered queries: every operator over corpora derived from the given tables."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as H
from ..operators import classify as K
from ..operators import py_units as P
from ..operators import reports as R
from ..operators import sql_units as S
from ..operators.units import as_units, extract_units
from ..session import keep, shared_dir
from ..sources import files as files_source
from ..sources.docs_tree import read_archives, write_tree
from ..sources.partitions import remove
from ..sources.snapshots import compact, new_write_id, one_run, read_rows, write_rows, write_snapshot
from ..streaming import events as E
from . import corpora as C

Query = Callable[[SparkSession, str], DataFrame]
REPO_URL = "https://code.example/repo"
GENERATED = "2024-01-01T00:00:00Z"


def _list(col: str) -> Column:
    return F.array_join(F.col(col), "|").alias(col)


# --- SQL -------------------------------------------------------------------------------


def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.sql_blocks(C.sql_by_customer(spark, sf_dir))
    return blocks.select(
        "file_path", "ordinal", "start_line", "end_line", F.md5("source_code").alias("text_md5")
    )


def sql_statement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.sql_blocks(C.sql_by_order(spark, sf_dir))
    return blocks.select("file_path", "sql_type", "name")


def sql_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sql_blocks(C.sql_by_order(spark, sf_dir)).select("file_path", "description")


def sql_rule_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.sql_blocks(C.sql_by_order(spark, sf_dir))
    return blocks.select("file_path", F.explode("markers").alias("marker"))


def sql_table_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.sql_blocks(C.sql_by_order(spark, sf_dir))
    return (
        blocks.select(F.explode("tables").alias("table_name"))
        .groupBy("table_name")
        .agg(F.count("*").alias("n"))
    )


def sql_output_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sql_blocks(C.sql_by_order(spark, sf_dir)).select("file_path", _list("columns"))


def embedded_sql_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.embedded_sql(C.embedded_by_nation(spark, sf_dir))
    return blocks.select(
        "file_path", "ordinal", "name", "start_line", "end_line", "source_code", _list("tables")
    )


# --- Python ----------------------------------------------------------------------------


def py_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.functions(C.py_by_tens(spark, sf_dir)).select(
        "file_path",
        "ordinal",
        "name",
        "start_line",
        "end_line",
        "signature",
        "return_type",
        _list("decorators"),
        F.md5("source_code").alias("text_md5"),
    )


def py_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.functions(C.py_by_tens(spark, sf_dir)).select(
        "file_path",
        "ordinal",
        F.posexplode("parameters").alias("position", "p"),
    ).select(
        "file_path",
        "ordinal",
        "position",
        F.col("p.name").alias("parameter"),
        F.col("p.type").alias("type"),
        F.col("p.default").alias("default_value"),
    )


def py_docs_and_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.functions(C.py_by_tens(spark, sf_dir)).select(
        "file_path", "ordinal", "docstring", _list("markers")
    )


# --- labels ----------------------------------------------------------------------------


def corpus_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all three corpora; each is read by the one operator it has work for."""
    return as_units(
        P.functions(C.py_by_tens(spark, sf_dir)),
        S.sql_blocks(C.sql_by_customer(spark, sf_dir)).unionByName(
            S.embedded_sql(C.embedded_by_nation(spark, sf_dir))
        ),
    )


def labelled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify(corpus_units(spark, sf_dir))


def index_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What indexes and overviews need of a unit, extracted once for all their parts."""
    units = labelled_units(spark, sf_dir)
    return keep(
        units.select(
            "kind", "file_path", "ordinal", "name", "sql_type", "classification",
            F.when(F.col("kind") == "function", F.col("description")).alias("description"),
        )
    )


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` as units: real prose, long rows, several languages."""
    return C.rows(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        F.col("source").alias("name"),
        F.col("text").alias("source_code"),
        F.col("lang").alias("description"),
        F.array().cast("array<string>").alias("markers"),
    )


def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.scores(corpus_units(spark, sf_dir)).select(
        "kind", "file_path", "ordinal", "business_score", "pipeline_score"
    )


def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_units(spark, sf_dir).select(
        "kind", "file_path", "ordinal", "name", *K.RESULT
    )


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify(document_units(spark, sf_dir)).select("doc_id", *K.RESULT)


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.label_counts(labelled_units(spark, sf_dir))


def ambiguous_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ambiguous_requests(document_units(spark, sf_dir)).select(
        "doc_id", F.md5("request").alias("request_md5")
    )


def _answer_by_length(request: str) -> str:
    """Stand-in for an external classifier: depends on the request text only."""
    if len(request) % 7 == 0:
        raise RuntimeError("no answer")
    if len(request) % 5 == 0:
        return "cannot tell"
    label = "business_logic" if len(request) % 2 == 0 else "pipeline_code"
    return f'I think {{"classification": "{label}", "reason": "length {len(request)}"}}'


def asked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify(document_units(spark, sf_dir), _answer_by_length).select("doc_id", *K.RESULT)


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = C.table(spark, sf_dir, "labels").select(
        "doc_id", F.expr(C.ANSWER_TEXT).alias("response")
    )
    return K.parse_answers(answers).select("doc_id", *K.RESULT)


# --- snapshots and changes ---------------------------------------------------------------


def _snapshot(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    units = K.classify(as_units(None, S.sql_blocks(C.sql_version(spark, sf_dir, version))))
    label = F.col("classification")
    other = F.when(label == K.BUSINESS, F.lit(K.PIPELINE)).otherwise(F.lit(K.BUSINESS))
    units = units.withColumn("classification", F.when(F.col("relabel"), other).otherwise(label))
    run_ts = F.to_timestamp(F.lit(f"2024-01-0{version} 00:00:00"))
    return H.snapshot(units, f"run{version}", run_ts, f"c{version}")


def batch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs kept, one of them written again, a third write broken off: what is in force.

    Run 1 is the first version, run 2 the second; run 1 is written a second time with the
    same rows; a write of the first version's rows under run 2 stops after its rows, before
    its entry. The history is compacted, then read: per run and label, the count and a sum
    of the hashes' first 28 bits. The first version's rows go into three writes, so they are
    labelled once and kept as a table until then.
    """
    folder = uuid.uuid4().hex
    home, first = (f"{shared_dir(spark)}/{kind}-{folder}" for kind in ("history", "first"))
    _snapshot(spark, sf_dir, 1).write.parquet(first)
    kept = spark.read.parquet(first)
    for version in (1, 2, 1):
        run = one_run(spark, f"run{version}", datetime.datetime(2024, 1, version), f"c{version}")
        # the run as a literal: a column read back would have to be sorted by for its folder
        snap = _snapshot(spark, sf_dir, 2) if version == 2 else kept.withColumn("run_id", F.lit("run1"))
        write_snapshot(snap, home, run)
    write_rows(kept.withColumn("run_id", F.lit("run2")), home, new_write_id())
    remove(spark, first)
    compact(spark, home)
    return (
        read_rows(spark, home)
        .groupBy("run_id", "classification")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.conv(F.substring("hash", 1, 7), 16, 10).cast("long")).alias("hash_sum"),
        )
    )


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last unit per key of the first version; half of the files hold two units of one name."""
    units = K.classify(as_units(None, S.sql_blocks(C.sql_by_customer(spark, sf_dir))))
    rows = H.dedupe_units(
        H.snapshot(units, "run1", F.to_timestamp(F.lit("2024-01-01 00:00:00")), "c1")
    )
    return rows.select(
        "run_id", "commit", "kind", "file_path", "name", "ordinal", "position", "sql_type",
        "classification", "hash",
    )


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.changes(_snapshot(spark, sf_dir, 1), _snapshot(spark, sf_dir, 2))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).select(
        "kind", "file_path", "name", "change",
        F.col("prev.hash").alias("prev_hash"), F.col("curr.hash").alias("curr_hash"),
        "from_class", "to_class", "position",
    )


def first_run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units are added; half of the files hold two units of one name, of which one counts."""
    units = K.classify(as_units(None, S.sql_blocks(C.sql_by_customer(spark, sf_dir))))
    rows = H.snapshot(units, "run1", F.to_timestamp(F.lit("2024-01-01 00:00:00")), "c1")
    return H.changes(None, rows).select(
        "kind", "file_path", "name", "change", F.col("curr.hash").alias("curr_hash"), "position"
    )


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.change_counts(_changed(spark, sf_dir))


def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.change_report(keep(_changed(spark, sf_dir)), GENERATED)


# --- reports -----------------------------------------------------------------------------


def _page_columns(pages: DataFrame) -> DataFrame:
    return pages.select(
        "category", "file_path", "md_path", "chunk", F.md5("body").alias("body_md5")
    )


def function_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = keep(K.classify(as_units(P.functions(C.py_by_tens(spark, sf_dir)), None)))
    return _page_columns(R.function_pages(units, REPO_URL))


def sql_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = keep(K.classify(as_units(None, S.sql_blocks(C.sql_by_customer(spark, sf_dir)))))
    return _page_columns(R.sql_pages(units))


def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.category_index(index_units(spark, sf_dir))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overview(labelled_units(spark, sf_dir))


def quick_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quick_links(index_units(spark, sf_dir))


def overview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overview_page(index_units(spark, sf_dir), GENERATED)


def written_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The docs tree written through the committing sink, read back: one row per document.

    There is about one page per row of ``orders``, of some 450 bytes, so the tree is kept in
    archives: as files each page would take a block of the disk.
    """
    home = f"{shared_dir(spark)}/docs-{uuid.uuid4().hex}"
    labelled_units(spark, sf_dir).write.parquet(f"{home}/units")  # read by three documents
    units = spark.read.parquet(f"{home}/units")
    write_tree(R.tree_lines(units, REPO_URL, GENERATED), f"{home}/tree", archives=True)
    remove(spark, f"{home}/units")
    back = read_archives(spark, f"{home}/tree", facts=True)
    return back.select(F.col("file_path").alias("path"), "n_lines", "text_md5")


# --- events and files --------------------------------------------------------------------


def push_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    handled = E.handle_events(C.push_events(spark, sf_dir), C.TEST_SECRET)
    return handled.select("event_id", "status", "action", "ref", "commit", "message")


def push_stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land as files, a stream runs their commits, the history is counted.

    The corpus of a commit is the orders of one year and the year before, so commits grow
    with the data in number of files, not in number of commits.
    """
    home = f"{shared_dir(spark)}/push-{uuid.uuid4().hex}"
    C.commit_events(spark, sf_dir).write.json(f"{home}/events")
    C.files_by_commit(spark, sf_dir).write.partitionBy("commit").parquet(f"{home}/files")
    stream = E.read_push_events(spark, f"{home}/events")
    query = E.run_stream(stream, f"{home}/files", f"{home}/history", f"{home}/state", C.TEST_SECRET)
    query.awaitTermination()
    rows = read_rows(spark, f"{home}/history").groupBy("run_id", "classification")
    changed = spark.read.parquet(f"{home}/history/changes").groupBy("run_id", "change")
    return (
        rows.agg(F.count("*").alias("n"))
        .select("run_id", F.lit("units").alias("what"), F.col("classification").alias("item"), "n")
        .unionByName(
            changed.agg(F.count("*").alias("n")).select(
                "run_id", F.lit("changes").alias("what"), F.col("change").alias("item"), "n"
            )
        )
    )


def scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus written as a tree of files, scanned back and extracted."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    files_source.write_files(C.tree_files(spark, sf_dir), root).write.format("noop").mode(
        "overwrite"
    ).save()
    units = extract_units(files_source.scan_sources(spark, root))
    return units.select(
        "kind", "file_path", "ordinal", "name", "start_line", F.md5("source_code").alias("text_md5")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        sql_statements,
        sql_statement_types,
        sql_descriptions,
        sql_rule_markers,
        sql_table_usage,
        sql_output_columns,
        embedded_sql_blocks,
        py_functions,
        py_parameters,
        py_docs_and_markers,
        unit_scores,
        unit_labels,
        document_labels,
        label_counts,
        ambiguous_requests,
        asked_labels,
        parsed_answers,
        snapshot_rows,
        batch_history,
        changes,
        first_run_changes,
        change_counts,
        change_report,
        function_pages,
        sql_pages,
        category_index,
        overview,
        quick_links,
        overview_page,
        written_docs,
        push_admission,
        push_stream_runs,
        scan_roundtrip,
    )
}
