"""Substring dedup: seeds by winnowing, extension both ways, maximal repeats.

Every window of ``WINDOW`` words names the least of its ``GRAM``-word hashes; these are the
anchors (winnowing), so two equal windows name the same anchor at the same offset. Documents are
joined on anchors. An anchor is then extended as far as a window around it can reach, both
ways: occurrences with the same surroundings repeat each other whole, and one of them, the first,
speaks for all. Where surroundings differ, the windows themselves are compared. Repeated windows
that touch make one maximal repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import add_columns, batches_of, col
from .tables import Workspace
from .word_hashes import fingerprint, sequence_hashes, word_hashes

WINDOW = 50
GRAM = 12
_STEP = 1 << 16


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of each window, and the hashes of all grams. First of equals."""
    grams = sequence_hashes(words, gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.empty(0, np.int64), grams
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    least = [
        views[i : i + _STEP].argmin(axis=1) + np.arange(i, min(i + _STEP, len(views)))
        for i in range(0, len(views), _STEP)
    ]
    return np.concatenate(least), grams


def surroundings(words: np.ndarray, places: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Hash of all words that a window with its anchor at a place can hold."""
    sums = np.zeros(len(words) + 1, np.uint64)
    up = np.full(len(words) + 1, np.uint64(0x9E3779B97F4A7C15))
    up[0] = 1
    up = np.cumprod(up)
    np.cumsum(words * up[:-1], out=sums[1:])
    starts = np.maximum(0, places - (window - gram))
    ends = np.minimum(len(words), places + window)
    inverse = np.full(len(words) + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    body = (sums[ends] - sums[starts]) * inverse[starts]
    shape = (ends - starts) * 4096 + (places - starts)
    return body ^ (shape.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc, tag (of its words), and the places, hashes and surroundings of its anchors."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = word_hashes(text.as_py(), lower=False)
                if len(words) < window or not doc_id.is_valid:
                    continue
                named, grams = anchors(words, window, gram)
                places = np.unique(named)
                around = surroundings(words, places, window, gram)
                out.append(
                    (
                        doc_id.as_py(),
                        fingerprint(words),
                        places.astype(np.int32),
                        grams[places].view(np.int64),
                        around.view(np.int64),
                    )
                )
            yield from batches_of(out, names, kinds, 2000)

    names = ["doc", "tag", "places", "hashes", "around"]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return docs.mapInArrow(
        run, "doc long, tag binary, places array<int>, hashes array<long>, around array<long>"
    )


def windows_of(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """doc, tag, start and hash of the windows that name one of the wanted anchors."""

    def run(batches):
        for batch in batches:
            for doc_id, text, parts in zip(*batch.columns, strict=True):
                words = word_hashes(text.as_py(), lower=False)
                if len(words) < window:
                    continue
                tag = fingerprint(words)
                places = [p for part in parts.as_py() if part["tag"] == tag for p in part["places"]]
                if not places:
                    continue
                named, _ = anchors(words, window, gram)
                starts = np.flatnonzero(np.isin(named, np.array(places)))
                hashes = sequence_hashes(words, window)[starts].view(np.int64)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, doc_id.as_py()), pa.int64()),
                        pa.array([tag] * n, pa.binary()),
                        pa.array(starts, pa.int32()),
                        pa.array(hashes, pa.int64()),
                    ],
                    names=["doc", "tag", "start", "hash"],
                )

    joined = docs.join(wanted, docs["doc_id"] == wanted["doc"]).select("doc_id", "text", "parts")
    return joined.mapInArrow(run, "doc long, tag binary, start int, hash long")


def _per_document(rows: DataFrame, *lists: str) -> DataFrame:
    """One row per document with the lists of each of its texts; as long as the texts at most."""
    by_text = rows.groupBy("doc", "tag").agg(*[F.collect_list(c).alias(f"{c}s") for c in lists])
    part = F.struct("tag", *[f"{c}s" for c in lists])
    return by_text.groupBy("doc").agg(F.collect_list(part).alias("parts"))


def repeats(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    work: Workspace | None = None,
) -> DataFrame:
    """doc, parts: per text of a document its repeated anchors and window starts, or ``whole``.

    A text is known by the hash of its words, so rows that share an id keep apart.
    """
    work = work or Workspace(documents.sparkSession, "substring-dedup")
    docs = documents.select(
        col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")
    )
    found = work.keep(seeds(docs, window, gram), "seeds")
    # equal texts: the first speaks for all, the others are repeats from end to end
    first = found.groupBy("tag").agg(F.min("doc").alias("doc"))
    whole = found.select("doc", "tag").join(first.withColumnRenamed("doc", "first"), "tag")
    whole = whole.where("doc > first").select("doc", "tag").distinct()
    single = found.join(first, ["tag", "doc"], "left_semi")
    each = single.select(
        "doc", "tag", F.inline(F.arrays_zip("places", "hashes", "around"))
    ).withColumnsRenamed({"places": "place", "hashes": "hash"})
    each = work.keep(each, "anchors")
    shared = each.groupBy("hash").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi"),
        (F.min("around") != F.max("around")).alias("differ"),
    )
    shared = shared.where("lo <> hi").select("hash", "differ")
    met = work.keep(each.join(shared, "hash"), "shared-anchors")
    work.drop("anchors")
    speakers = met.groupBy("hash", "around").agg(F.min("doc").alias("speaker"))
    told = work.keep(met.join(speakers, ["hash", "around"]), "extended")
    extended = told.where("doc > speaker").select("doc", "tag", "place")
    open_ = told.where("differ and doc = speaker").select("doc", "tag", "place")
    wanted = _per_document(open_, "place")
    rows = work.keep(windows_of(docs, wanted, window, gram), "windows")
    least = rows.groupBy("hash").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    least = least.where("lo <> hi").select("hash", "lo")
    matched = rows.join(least, "hash").where("doc > lo").select("doc", "tag", "start")
    none = F.lit(None).cast("int")
    marks = (
        extended.select("doc", "tag", "place", none.alias("start"), F.lit(None).cast("boolean").alias("whole"))
        .union(matched.select("doc", "tag", none.alias("place"), "start", F.lit(None).cast("boolean")))
        .union(whole.select("doc", "tag", none, none, F.lit(True)))
    )
    return work.keep(_per_document(marks, "place", "start", "whole"), "marks")


def cover(words: np.ndarray, part: dict | None, window: int, gram: int) -> np.ndarray:
    """Which words of a text its repeats cover."""
    hit = np.zeros(len(words) + 1, np.int32)
    if part is None:
        return hit[:-1].astype(bool)
    if part["wholes"]:
        return np.ones(len(words), bool)
    starts = np.array(part["starts"], np.int64)
    if part["places"]:
        named, _ = anchors(words, window, gram)
        starts = np.concatenate([starts, np.flatnonzero(np.isin(named, np.array(part["places"])))])
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + window, -1)
    return np.cumsum(hit[:-1]) > 0


def spans(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs as (first word, word behind the last)."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def mark(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    digest: bool = False,
    work: Workspace | None = None,
) -> DataFrame:
    """``documents`` with n_words, n_removed and ``repeats array<struct<first, behind>>``.

    ``repeats`` are word numbers, end exclusive; with ``digest`` there is ``kept_sha256`` of the
    kept words in its place. Words are split at white space and compared as they are.
    A null text has no words; texts of fewer than ``window`` words repeat nothing. Of equal
    windows those of the smallest id stay, all of them; a row without an id neither removes nor
    loses words, and rows of one id don't remove each other. Columns with these names, or
    named ``__marks``, are replaced.
    """
    marks = repeats(documents, id_col, text_col, window, gram, work)
    marks = marks.select(F.col("doc").alias("__doc"), F.col("parts").alias("__marks"))
    last = "kept_sha256 string" if digest else "repeats array<struct<first: int, behind: int>>"
    schema = f"n_words long, n_removed long, {last}"

    def one(text, parts):
        words = word_hashes(text, lower=False)
        tag = fingerprint(words) if parts else None
        part = next((p for p in parts or () if p["tag"] == tag), None)
        covered = cover(words, part, window, gram)
        n = int(covered.sum())
        if not digest:
            return len(words), n, [{"first": a, "behind": b} for a, b in spans(covered)]
        raw = (text or "").encode().split()
        if n:
            raw = [w for w, gone in zip(raw, covered.tolist(), strict=True) if not gone]
        return len(words), n, hashlib.sha256(b" ".join(raw)).hexdigest()

    names = [c for c in documents.columns if c not in ("__marks", "__doc")]
    key = col(id_col).cast("long")
    wide = documents.select(*[col(c) for c in names])
    wide = wide.join(marks, key == F.col("__doc"), "left").drop("__doc")
    return add_columns(wide, [text_col, "__marks"], schema, lambda: one).drop("__marks")
