"""Push events: a file stream, its checks, and the runs it starts."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.changes import KEY, changes, snapshot
from ..operators.classify import classify
from ..operators.units import extract_units
from ..sources.files import read_landed
from ..sources.partitions import drop_partitions, has_files, partition_path, read_partitions
from ..sources.snapshots import last_done, read_rows, write_snapshot

EVENT_SCHEMA = (
    "event_id long, ts timestamp, event string, method string, url string, "
    "signature string, body string"
)
PENDING_SCHEMA = "at long, event_id long, commit string"
#: Commits that one job takes, which is also what the driver holds of them.
BLOCK = 500
# Accepted paths, branches that start a run, and texts for missing fields.
PATHS = ("/webhook", "/")
MAIN_REFS = ("refs/heads/main", "refs/heads/master")
PUSH_DEFAULTS = {"ref": "refs/heads/main", "commit": "unknown", "message": "No message"}
DISPATCH_DEFAULTS = {"ref": "main", "commit": "unknown", "message": "Dispatch trigger"}

_BODY = (
    "array<struct<ref:string,head_commit:struct<id:string,message:string>,"
    "client_payload:struct<ref:string,commit_sha:string,commit_message:string>>>"
)


def read_push_events(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Events that land as JSON files; ``max_files`` bounds a micro-batch."""
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .json(folder)
    )


def hmac_sha256(secret: str, text: Column) -> Column:
    """Hexadecimal HMAC-SHA256 as two nested hashes with constant pads.

    The pads are literals of the plan: keep plan texts as private as the secret.
    """
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")

    def pad(byte: int) -> Column:
        return F.lit(bytearray(b ^ byte for b in key))

    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def admitted(method: Column, url: Column) -> Column:
    """Status that refuses a request before its body is looked at, or null."""
    return F.when(~method.eqNullSafe("POST"), F.lit(405)).when(
        ~F.coalesce(url.isin(*PATHS), F.lit(False)), F.lit(404)
    )


def verified(body: Column, signature: Column, secret: str | None) -> Column:
    """True if the signature fits the body; without a secret everything passes."""
    if not secret:
        return F.lit(True)
    expected = F.concat(F.lit("sha256="), hmac_sha256(secret, body))
    return F.coalesce(signature == expected, F.lit(False))


def parsed_body(body: Column) -> Column:
    """The body as a one-element array; null or another length if it is not JSON.

    Inside the array brackets the parser has to reach the end of the text.
    """
    return F.from_json(
        F.concat(F.lit("["), body, F.lit("]")),
        _BODY,
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    )


def _is_json(body: Column, parsed: Column) -> Column:
    # a body that is valid but no object has no fields to read
    other = ~F.startswith(F.ltrim(body), F.lit("{")) & F.try_parse_json(body).isNotNull()
    return F.coalesce(F.size(parsed) == 1, F.lit(False)) | F.coalesce(other, F.lit(False))


def handle_events(events: DataFrame, secret: str | None = None) -> DataFrame:
    """Add ``status``, ``action``, ``ref``, ``commit`` and ``message`` to every event.

    Checks run in the order method, path, signature, JSON; the first that fails
    sets the status. ``action`` is run, ignore or null (refused).
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    parsed = F.col("__parsed")
    refused = F.coalesce(
        admitted(F.col("method"), F.col("url")),
        F.when(~verified(body, F.col("signature"), secret), F.lit(401)),
        F.when(~_is_json(body, parsed), F.lit(400)),
    )
    checked = events.withColumn("__parsed", parsed_body(body)).withColumn(
        "status", F.coalesce(refused, F.lit(200))
    )

    accepted = F.col("status") == 200
    push, dispatch = F.col("event") == "push", F.col("event") == "repository_dispatch"
    one = F.get(parsed, F.lit(0))

    def field(of_push: Column, of_dispatch: Column, name: str) -> Column:
        def or_default(value: Column, default: str) -> Column:
            return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))

        return (
            F.when(accepted & push, or_default(of_push, PUSH_DEFAULTS[name]))
            .when(accepted & dispatch, or_default(of_dispatch, DISPATCH_DEFAULTS[name]))
            .alias(name)
        )

    payload = one["client_payload"]
    routed = checked.select(
        *events.columns,
        "status",
        field(one["ref"], payload["ref"], "ref"),
        field(one["head_commit"]["id"], payload["commit_sha"], "commit"),
        field(one["head_commit"]["message"], payload["commit_message"], "message"),
    )
    runs = dispatch | (push & F.col("ref").isin(*MAIN_REFS))
    return routed.withColumn(
        "action",
        F.when(accepted & F.coalesce(runs, F.lit(False)), F.lit("run")).when(
            accepted, F.lit("ignore")
        ),
    )


def _waiting(spark: SparkSession, table: str) -> DataFrame:
    """Commits asked for that had no landed files yet, one row each."""
    folder = f"{table}/pending"
    if not has_files(spark, folder):
        return spark.createDataFrame([], PENDING_SCHEMA)
    return spark.read.schema(PENDING_SCHEMA).parquet(folder)


def _asked(batch: DataFrame, secret: str | None, table: str) -> DataFrame:
    """One row per commit to run, of this batch or waiting: its last event, in time order."""
    events = handle_events(batch, secret).filter(F.col("action") == "run")
    events = events.select("commit", F.unix_micros("ts").alias("at"), "event_id")
    waiting = _waiting(batch.sparkSession, table).withColumn("waited", F.lit(True))
    return (
        events.withColumn("waited", F.lit(False))
        .unionByName(waiting)
        .groupBy("commit")
        .agg(F.max(F.struct("at", "event_id")).alias("last"), F.max("waited").alias("waited"))
        .select("commit", "last.at", "last.event_id", "waited")
        .orderBy("at", "event_id", "commit")
    )


def run_batch_of_events(
    batch: DataFrame,
    source_table: str,
    table: str,
    secret: str | None = None,
    ambiguous: Callable[[str], str] | None = None,
    units_table: str | None = None,
    batch_key: str | None = None,
) -> None:
    """Extract, label and snapshot the commits that a batch of events asks for.

    Runs count in the order in which they are done: the first of a batch is compared with the
    last run done before the batch, each other one with the one before it; inside a batch they
    go by time and id of their events. ``batch_key`` names the batch, so that a repeated one
    finds the same run before it. Every write replaces the run it belongs to.

    Commits are taken ``BLOCK`` at a time, each block one job over the folders of its commits
    and of the runs they are compared with; nothing else of the landed table or of the
    rows in the history is listed or read. A commit that has not landed waits in ``pending``
    below ``table`` and is tried again with every batch, an empty one too. An event without
    ``ts`` runs at the time of its batch.
    """
    spark = batch.sparkSession
    now = F.lit(datetime.datetime.now(datetime.timezone.utc)).cast("timestamp")
    batch = batch.withColumn("ts", F.coalesce("ts", now) if "ts" in batch.columns else now)
    previous, seq = last_done(spark, table, batch_key)
    served: list[str] = []
    asked = _asked(batch, secret, table).toLocalIterator()
    while block := list(islice(asked, BLOCK)):
        landed, absent = [], []
        for row in block:
            folder = partition_path(spark, source_table, "commit", row.commit)
            (landed if has_files(spark, folder) else absent).append(row)
        if absent:
            rows = {c: [row[c] for row in absent] for c in ("at", "event_id", "commit")}
            _replace(_local(spark, rows, PENDING_SCHEMA), f"{table}/pending", "commit")
        if landed:
            ids = [row.commit for row in landed]
            rows = {
                "run_id": ids,
                "at": [row.at for row in landed],
                "seq": list(range(seq + 1, seq + 1 + len(ids))),
                "previous": [previous, *ids[:-1]],
                "batch": [batch_key] * len(ids),
            }
            _run_block(spark, rows, source_table, table, ambiguous, units_table)
            previous, seq = ids[-1], seq + len(ids)
            served += [row.commit for row in landed if row.waited]
    drop_partitions(spark, f"{table}/pending", "commit", served)


def _local(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table whose rows are part of the plan, so that its size is known to it."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table(columns, schema=fields))


def _run_block(
    spark: SparkSession,
    rows: dict[str, list],
    source_table: str,
    table: str,
    ambiguous: Callable[[str], str] | None,
    units_table: str | None,
) -> None:
    ids, before = rows["run_id"], rows["previous"]
    runs = _local(
        spark, rows, "run_id string, at long, seq long, previous string, batch string"
    ).withColumns({"run_ts": F.timestamp_micros("at"), "commit": F.col("run_id")})

    wanted = read_landed(spark, source_table, ids).join(runs.select("commit", "run_ts"), "commit")
    units = classify(extract_units(wanted), ambiguous)
    if units_table is not None:
        drop_partitions(spark, units_table, "commit", ids)
        _replace(units, units_table, "commit")
        units = read_partitions(spark, units_table, units.schema, "commit", ids)
    write_snapshot(
        snapshot(units, F.col("commit"), F.col("run_ts"), F.col("commit")), table, runs
    )

    pairs = runs.filter(F.col("previous").isNotNull()).select("run_id", "previous")
    current = read_rows(spark, table, ids).join(pairs, "run_id").drop("previous")
    previous = (
        read_rows(spark, table, [p for p in before if p is not None])
        .withColumnRenamed("run_id", "previous")
        .join(pairs, "previous")
        .drop("previous")
    )
    key = ("run_id", *KEY)
    found = changes(previous, current, key=key)
    if before[0] is None:
        found = found.unionByName(changes(None, read_rows(spark, table, ids[:1]), key=key))
    drop_partitions(spark, f"{table}/changes", "run_id", ids)
    _replace(found, f"{table}/changes", "run_id")


def _replace(df: DataFrame, folder: str, column: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(folder)
    )


def run_stream(
    events: DataFrame,
    source_table: str,
    table: str,
    checkpoint: str,
    secret: str | None = None,
    ambiguous: Callable[[str], str] | None = None,
    units_table: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream: every event that passes the checks starts a run of its commit.

    ``source_table`` holds the landed files by commit (``land_sources``), ``table``
    is the snapshot history. With ``units_table`` the labelled units are kept by
    commit too, so that reports can be written for any run.
    """
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: run_batch_of_events(
            batch, source_table, table, secret, ambiguous, units_table, f"{checkpoint}#{number}"
        )
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
