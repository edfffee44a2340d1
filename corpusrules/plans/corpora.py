"""Source-code corpora derived from the relational tables.

The tables hold no code, so every row of ``orders``, ``part`` and ``supplier``
is turned into a piece of code text, and pieces are joined into files. The text
expressions are valid in Spark SQL and in DuckDB. No row of a table is left out.

Files are cut by key range as well as by owner, so a file holds a bounded number
of pieces however many rows one customer or nation has.
"""

from __future__ import annotations

import hmac

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

SQL_TEXT = """
case when o_orderkey%10 in (5, 7) then '' else '-- name: q_'||o_orderkey||chr(10)||'-- '||o_orderpriority||chr(10)
||case when o_orderkey%3=0 then '-- BUSINESS_RULE: cap '||(o_orderkey%50)||chr(10) else '' end end
||case when o_orderkey%5=0 then 'CREATE VIEW v_'||o_orderkey||' AS'||chr(10)
when o_orderkey%5=1 then 'INSERT INTO dim.sink'||(o_orderkey%3)||chr(10)
when o_orderkey%10=7 then 'CREATE OR REPLACE PROCEDURE p_'||o_orderkey||'() AS $$'||chr(10)||'BEGIN;'||chr(10) else '' end
||'SELECT a.k, b.v AS '||case when o_orderkey%4=0 then 'threshold' when o_orderkey%4=1 then 'kpi_limit' when o_orderkey%4=2 then 'v' else 'to_csv' end||chr(10)
||'FROM orders_'||(o_orderkey%7)||' a'||chr(10)||'  -- mid;'||chr(10)||'JOIN dim.t'||(o_orderkey%4)||' b ON a.k = b.k'
||case when o_orderkey%10=7 then ';'||chr(10)||'END;'||chr(10)||'$$' else '' end
||case when o_orderkey%11=0 then '' else ';' end||chr(10)
"""

PY_TEXT = """
case when p_partkey%6=0 then '@deco('||p_size||')'||chr(10) else '' end
||case when p_partkey%5=0 then 'async ' else '' end
||'def '||case p_partkey%4 when 0 then 'load_' when 1 then 'validate_' when 2 then 'setup_' else 'f_' end||p_partkey||'(self, a: int, b='||p_size||', *args, c: str = "x")'
||case when p_partkey%2=0 then ' -> float' else '' end||':'||chr(10)
||case when p_partkey%3=0 then '    \"\"\"'||p_name||'.'||chr(10)||chr(10)||'    BUSINESS_RULE: size '||p_size||chr(10)||'    \"\"\"'||chr(10) else '' end
||case when p_partkey%7=0 then '    # BUSINESS_RULE = brand '||p_brand||chr(10) else '' end
||case when p_partkey%8=1 then '    spark.read.parquet(a)'||chr(10) else '' end
||'    return '||p_size||chr(10)
"""

EMBEDDED_TEXT = """
'x = '||s_suppkey||chr(10)
||case when s_suppkey%3=0 then 'spark.sql(f'||repeat('"',3)||chr(10)||'SELECT a FROM t'||s_nationkey||chr(10)||repeat('"',3)||')'
when s_suppkey%3=1 then 'cur.execute( "UPDATE s'||s_suppkey||' SET a = 1")'
else 'sql("hello")' end||chr(10)
"""

# pieces per file, at most
ORDERS_PER_FILE = 4096
PARTS_PER_FILE = 10
SUPPLIERS_PER_FILE = 1024

TEST_SECRET = "corpus-test-secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows become texts: enough tasks for the work that follows."""
    return spread(table(spark, sf_dir, name), key)


def sql_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order; no shuffle."""
    return rows(spark, sf_dir, "orders", "o_orderkey").select(
        F.expr("'sql/o'||o_orderkey||'.sql'").alias("file_path"),
        F.expr(SQL_TEXT).alias("content"),
    )


def _joined(source: DataFrame, path: str, text: str, key: str) -> DataFrame:
    # Grouped rows are moved before they become text, so the shuffle is narrow. A fixed
    # number of partitions keeps the work that follows parallel where the text is small.
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        source.withColumn("file_path", F.expr(path))
        .repartition(tasks, "file_path")
        .select("file_path", F.expr(text).alias("piece"), F.col(key).alias("k"))
        .groupBy("file_path")
        .agg(F.expr("listagg(piece, chr(10)) within group (order by k)").alias("content"))
    )


def sql_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL texts of one customer and one range of order keys per file."""
    path = f"'sql/c'||o_custkey||'-'||(o_orderkey div {ORDERS_PER_FILE})||'.sql'"
    return _joined(table(spark, sf_dir, "orders"), path, SQL_TEXT, "o_orderkey")


def py_by_tens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten functions per file."""
    path = f"'py/p'||(p_partkey div {PARTS_PER_FILE})||'.py'"
    return _joined(table(spark, sf_dir, "part"), path, PY_TEXT, "p_partkey")


def embedded_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with SQL strings of one nation and one range of supplier keys per file."""
    path = f"'py/s'||s_nationkey||'-'||(s_suppkey div {SUPPLIERS_PER_FILE})||'.py'"
    return _joined(table(spark, sf_dir, "supplier"), path, EMBEDDED_TEXT, "s_suppkey")


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL files, Python files and Python files with SQL strings as one corpus."""
    return (
        sql_by_customer(spark, sf_dir)
        .unionByName(py_by_tens(spark, sf_dir))
        .unionByName(embedded_by_nation(spark, sf_dir))
    )


# --- two versions of a corpus -------------------------------------------------------------

# version 1 has no file of an urgent order, version 2 has none of a low one and changes some
VERSION_ROWS = {1: "o_orderpriority <> '1-URGENT'", 2: "o_orderpriority <> '5-LOW'"}
VERSION_TEXT = {
    1: SQL_TEXT,
    2: f"""replace({SQL_TEXT}, '-- mid;', '-- mid;'
||case when o_orderkey%14=0 then ' compliance' when o_orderkey%7=0 then ' note' else '' end)""",
}
# labels that version 2 turns over without a change of the text
VERSION_RELABEL = {1: "false", 2: "o_orderkey%26=0"}


def sql_version(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    return (
        rows(spark, sf_dir, "orders", "o_orderkey")
        .filter(VERSION_ROWS[version])
        .select(
            F.expr("'sql/o'||o_orderkey||'.sql'").alias("file_path"),
            F.expr(VERSION_TEXT[version]).alias("content"),
            F.expr(VERSION_RELABEL[version]).alias("relabel"),
        )
    )


# --- answers and events -------------------------------------------------------------------

ANSWER_TEXT = """
case when doc_id%5=0 then 'no idea'
when doc_id%7=0 then 'so {"classification": "other", "reason": "r'||doc_id||'"} ok'
when doc_id%11=0 then 'x {bad} y'
else 'I say {"classification": "'||case when quality=1 then 'business_logic' else 'pipeline_code' end
||'", "reason": "r'||doc_id||'"}'||chr(10)||'done' end
"""

EVENT_NAME = """
case event_id%5 when 0 then 'push' when 1 then 'repository_dispatch' when 2 then 'ping'
when 3 then 'push' else event_type end
"""
EVENT_METHOD = "case when event_id%17=0 then 'GET' else 'POST' end"
EVENT_URL = """
case when event_id%19=0 then '/x' when event_id%2=0 then '/' else '/webhook' end
"""
EVENT_BODY = """
case when event_id%23=0 then '{bad'
when event_id%31=0 then '{}'
when event_id%5=1 then '{"client_payload": {"ref": "r'||(event_id%3)||'", "commit_sha": "c'||user_id||'"}}'
else '{"ref": "refs/heads/'||case event_id%3 when 0 then 'main' when 1 then 'master' else 'dev' end
||'", "head_commit": {"id": "c'||user_id||'", "message": "'||case when event_id%7=0 then '' else 'm'||event_id end||'"}}' end
"""


@F.pandas_udf(T.StringType())
def _standard_signature(bodies: pd.Series) -> pd.Series:
    """Made by the standard library, not by the columns under test."""
    key = TEST_SECRET.encode()
    return bodies.map(lambda b: "sha256=" + hmac.new(key, b.encode(), "sha256").hexdigest())


def _signed(events: DataFrame) -> DataFrame:
    good = _standard_signature("body")
    return events.withColumn(
        "signature",
        F.when(F.col("event_id") % 29 == 0, F.lit(None))
        .when(F.col("event_id") % 13 == 0, F.concat(good, F.lit("0")))
        .otherwise(good),
    )


def push_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(
        rows(spark, sf_dir, "events", "event_id").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.expr(EVENT_NAME).alias("event"),
            F.expr(EVENT_METHOD).alias("method"),
            F.expr(EVENT_URL).alias("url"),
            F.expr(EVENT_BODY).alias("body"),
        )
    )


# --- one tree per commit ------------------------------------------------------------------

# The tree of a year holds the orders of that year and of the year before. An order's
# text may change in its second year.
COMMIT_TEXT = f"""replace({SQL_TEXT}, '-- mid;', '-- mid;'
||case when age=0 then '' when o_orderkey%14=0 then ' compliance' when o_orderkey%7=0 then ' note' else '' end)"""


def files_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        rows(spark, sf_dir, "orders", "o_orderkey")
        .withColumn("age", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            F.expr("'sql/o'||o_orderkey||'.sql'").alias("file_path"),
            F.expr(COMMIT_TEXT).alias("content"),
            F.expr("'y'||(year(o_orderdate) + age)").alias("commit"),
        )
    )


def commit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A push per year of the orders, and one of a commit that has no files."""
    years = (
        table(spark, sf_dir, "orders")
        .select(F.year("o_orderdate").alias("y"))
        .distinct()
        .select(F.explode(F.array("y", F.col("y") + 1, F.lit(2999))).alias("y"))
        .distinct()
    )
    return years.select(
        F.col("y").cast("long").alias("event_id"),
        F.make_timestamp("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"),
        F.lit("push").alias("event"),
        F.lit("POST").alias("method"),
        F.lit("/webhook").alias("url"),
        F.expr(
            """'{"ref": "refs/heads/main", "head_commit": {"id": "y'||y||'", "message": "m"}}'"""
        ).alias("body"),
    ).withColumn("signature", _standard_signature("body"))


# --- a tree of files ----------------------------------------------------------------------

TREE_PATHS = {
    "orders": "'sql/t'||({key} {div} 4096)||'.sql'",
    "part": "'py/_p'||({key} {div} 512)||'.py'",
    "supplier": "'py/sub/s'||({key} {div} 1024)||'.py'",
}


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut by key range alone; names of the Python files start with an underscore."""
    parts = [
        _joined(
            table(spark, sf_dir, name), TREE_PATHS[name].format(key=key, div="div"), text, key
        )
        for name, text, key in (
            ("orders", SQL_TEXT, "o_orderkey"),
            ("part", PY_TEXT, "p_partkey"),
            ("supplier", EMBEDDED_TEXT, "s_suppkey"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
