"""Snapshots of classified units and the differences between two of them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NL

KEY = ("kind", "file_path", "name")
# Change classes in report order, with the marks of the summary lines.
CHANGES = {
    "added": "➕ Added",
    "removed": "➖ Removed",
    "modified": "✏️ Modified",
    "reclassified": "🔄 Reclassified",
}
_ENTRY = ("ordinal", "signature", "sql_type", "classification", "hash")
ENTRY_TYPE = (
    "struct<ordinal:int,signature:string,sql_type:string,classification:string,hash:string>"
)


def snapshot(
    units: DataFrame,
    run_id: str | Column,
    run_ts: datetime.datetime | Column,
    commit: str | Column | None = None,
) -> DataFrame:
    """One narrow row per unit: no source text, only its hash."""

    def col(value, kind: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    def optional(name: str) -> Column:
        return F.col(name) if name in units.columns else F.lit(None).cast("string").alias(name)

    return units.select(
        col(run_id, "string").alias("run_id"),
        col(run_ts, "timestamp").alias("run_ts"),
        col(commit, "string").alias("commit"),
        "kind",
        "file_path",
        "name",
        "ordinal",
        optional("signature"),
        optional("sql_type"),
        "classification",
        F.md5("source_code").alias("hash"),
    )


def _entry() -> Column:
    return F.struct(*_ENTRY)


def dedupe_units(snap: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row per key: the last unit of that key wins, ``position`` is that of the first.

    Combines before the shuffle, so a key with very many units sends one row per task.
    """
    last = snap.groupBy(*key).agg(
        F.max_by(F.struct(*[c for c in snap.columns if c not in key]), F.col("ordinal")).alias("u"),
        F.min("ordinal").alias("position"),
    )
    return last.select(*key, "position", "u.*")


def _paired(previous: DataFrame, current: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key, last entry on each side (null if the side lacks the key), and position.

    A full outer join on the key after removing duplicates on both sides is the
    same as one grouping over the union of both; that needs one shuffle of narrow
    rows, which are combined before it.
    """
    wanted = list(dict.fromkeys([*key, *_ENTRY]))
    both = (
        previous.select(*wanted)
        .withColumn("now", F.lit(False))
        .unionByName(current.select(*wanted).withColumn("now", F.lit(True)))
    )

    def side(now: bool) -> tuple[Column, Column]:
        on = F.col("now") == now
        order = F.when(on, F.col("ordinal"))
        return F.max_by(_entry(), order), F.min(order)

    (prev, prev_at), (curr, curr_at) = side(False), side(True)
    return both.groupBy(*key).agg(
        prev.alias("prev"), curr.alias("curr"), F.coalesce(curr_at, prev_at).alias("position")
    )


def changes(
    previous: DataFrame | None, current: DataFrame, key: tuple[str, ...] = KEY
) -> DataFrame:
    """One row per unit and change between two snapshots.

    Without a previous snapshot every current unit is ``added``, duplicates
    included. ``key`` may be extended, by ``ordinal`` to compare every unit of a
    name or by ``run_id`` to compare many pairs of runs at once.
    """
    if previous is None:
        return current.select(
            *key,
            F.lit("added").alias("change"),
            F.lit(None).cast(ENTRY_TYPE).alias("prev"),
            _entry().alias("curr"),
            F.lit(None).cast("string").alias("from_class"),
            F.lit(None).cast("string").alias("to_class"),
            F.col("ordinal").alias("position"),
        )
    prev, curr = F.col("prev"), F.col("curr")
    found = F.when(prev.isNull(), F.array(F.lit("added")))
    found = found.when(curr.isNull(), F.array(F.lit("removed")))
    found = found.otherwise(
        F.filter(
            F.array(
                F.when(prev["hash"] != curr["hash"], F.lit("modified")),
                F.when(prev["classification"] != curr["classification"], F.lit("reclassified")),
            ),
            lambda c: c.isNotNull(),
        )
    )
    rows = _paired(previous, current, key).withColumn("change", F.explode(found))
    moved = F.col("change") == "reclassified"
    return rows.select(
        *key,
        "change",
        "prev",
        "curr",
        F.when(moved, prev["classification"]).alias("from_class"),
        F.when(moved, curr["classification"]).alias("to_class"),
        "position",
    )


def change_counts(changed: DataFrame) -> DataFrame:
    """``(change, n)`` with one row for each of the four classes, zero included."""
    one = changed.agg(*[F.count_if(F.col("change") == c).alias(c) for c in CHANGES])
    return one.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("change"), F.col(c).alias("n")) for c in CHANGES]
            )
        )
    )


# Sections of the report in order: title, change class, kind (None = both).
_SECTIONS = (
    ("Added Functions", "added", "function"),
    ("Added SQL Blocks", "added", "sql"),
    ("Removed Functions", "removed", "function"),
    ("Removed SQL Blocks", "removed", "sql"),
    ("Modified Functions", "modified", "function"),
    ("Modified SQL Blocks", "modified", "sql"),
    ("Reclassified Items", "reclassified", None),
)
REPORT_ORDER = ("section", "kind", "file_path", "position", "name")
_AFTER_ALL = 2**31 - 1


def change_report(changed: DataFrame, generated: str) -> DataFrame:
    """The report as lines; sorted by ``REPORT_ORDER`` they are the document.

    The number of lines grows with the number of changes, so the document is
    never put together in one row.
    """

    def is_in(change: str, kind: str | None) -> Column:
        same = F.col("change") == change
        return same if kind is None else same & (F.col("kind") == kind)

    name, path = F.col("name"), F.col("file_path")
    label = F.coalesce(F.col("curr.classification"), F.col("prev.classification"))
    item = (
        F.when(F.col("change") == "added", F.concat(F.lit("` in `"), path, F.lit("` ("), label, F.lit(")")))
        .when(F.col("change") == "removed", F.concat(F.lit("` from `"), path, F.lit("`")))
        .when(F.col("change") == "modified", F.concat(F.lit("` in `"), path, F.lit("`")))
        .otherwise(
            F.concat(
                F.lit("` in `"), path, F.lit("`: "),
                F.col("from_class"), F.lit(" → "), F.col("to_class"),
            )
        )
    )
    section = F.when(F.lit(False), F.lit(0))
    for i, (_, change, kind) in enumerate(_SECTIONS, 1):
        section = section.when(is_in(change, kind), F.lit(i))
    items = changed.select(
        section.alias("section"),
        "kind",
        "file_path",
        "position",
        "name",
        F.concat(F.lit("- `"), name, item).alias("line"),
    )

    # one row of counts gives the summary and tells which sections exist
    counts = changed.agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in CHANGES],
        *[F.count_if(is_in(c, k)).alias(f"s{i}") for i, (_, c, k) in enumerate(_SECTIONS, 1)],
    )

    def fixed(at: int, kind: str, position: int, text: Column, present: Column) -> Column:
        return F.when(
            present,
            F.struct(
                F.lit(at).alias("section"),
                F.lit(kind).alias("kind"),
                F.lit("").alias("file_path"),
                F.lit(position).alias("position"),
                F.lit("").alias("name"),
                text.alias("line"),
            ),
        )

    head = [F.lit("# Documentation Changes Report"), F.lit(""), F.lit(f"**Generated:** {generated}"), F.lit("")]
    head += [F.lit("## Summary"), F.lit("")]
    head += [F.concat(F.lit(f"- {mark}: "), F.col(c)) for c, mark in CHANGES.items()]
    head += [F.lit("")]
    rows = [fixed(0, "", i, text, F.lit(True)) for i, text in enumerate(head)]
    for i, (title, _, _) in enumerate(_SECTIONS, 1):
        present = F.col(f"s{i}") > 0
        rows.append(fixed(i, "", 0, F.lit(f"## {title}"), present))
        rows.append(fixed(i, "", 1, F.lit(""), present))
        # "~" sorts after the names of the kinds: the blank line ends the section
        rows.append(fixed(i, "~", _AFTER_ALL, F.lit(""), present))
    frame = counts.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    return items.unionByName(frame)
