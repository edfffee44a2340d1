"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents whose sets of word shingles have a Jaccard similarity of at least t share at
least ceil(t |x|) shingles. Under one order of all shingles, the first |x| - ceil(t |x|) + m
of each then have m in common. Rare shingles come first. Each document chooses its own m: a
longer prefix costs more postings but asks for more matches, and both are estimated
from counts of all shingles. A pair needs the lesser m of its two documents.

Only classes are wanted, not all pairs: sets that are equal are one node from the start.
Documents are first compared with few others that share the most prefix tokens; what that
links needs no further comparison with each other. All pairs of different classes that still
share enough tokens are then compared too, so no link between classes is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .rows import batches_of, col, let_go
from .tables import Workspace
from .word_hashes import fingerprint, shingles

SHINGLE = 5
PERCENT = 80
#: Size of the table of counts (a power of two) and of its pieces; fixed, whatever the input.
SKETCH, PIECE = 1 << 21, 1 << 13
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Postings that one comparison of two documents is worth.
COMPARE_COST = 20
PARTNERS = 2
#: Bitmap of a set: so many 64-bit numbers (a power of two), a column each.
BITMAP = [f"w{i}" for i in range(8)]


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n, fp, bitmap of each row; and the counts of all shingles, in pieces per task."""

    def run(batches):
        let_go()
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingles(text.as_py(), size)
                np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
                out.append((doc_id.as_py(), len(s), fingerprint(s), None, None, *bitmap(s)))
            yield from batches_of(out, names, kinds)
        for piece in range(SKETCH // PIECE):
            part = counts[piece * PIECE : (piece + 1) * PIECE]
            if part.any():
                row = (None, None, None, piece, part.tobytes(), *[None] * len(BITMAP))
                yield from batches_of([row], names, kinds)

    names = ["doc_id", "n", "fp", "piece", "counts", *BITMAP]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    kinds += [pa.int64()] * len(BITMAP)
    schema = "doc_id long, n long, fp binary, piece int, counts binary"
    return docs.mapInArrow(run, ", ".join([schema, *(f"{w} long" for w in BITMAP)]))


def bitmap(s: np.ndarray) -> list[int]:
    """One bit for each shingle of a set, by the top of its hash; different ones may share a bit."""
    size = 64 * len(BITMAP)
    flags = np.zeros(size, bool)
    flags[(s >> np.uint64(65 - size.bit_length())).astype(np.int64)] = True
    return np.packbits(flags).view(np.int64).tolist()


def merged_counts(rows: DataFrame) -> np.ndarray:
    """Sum of the pieces of all tasks: a table of fixed size, whatever the input."""

    def run(batches):
        let_go()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0), batch.column(1), strict=True):
                part = np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
                key = piece.as_py()
                sums[key] = sums[key] + part if key in sums else part
        yield from batches_of(
            [(k, np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes()) for k, v in sums.items()],
            ["piece", "counts"],
            [pa.int32(), pa.binary()],
            256,
        )

    pieces = rows.where("piece is not null").select("piece", "counts").repartition("piece")
    total = np.zeros(SKETCH, np.uint32)
    for piece, counts in pieces.mapInArrow(run, "piece int, counts binary").collect():
        total[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(counts, np.uint32)
    return total


def prefix(
    s: np.ndarray, counts: np.ndarray, usual: float, percent: int
) -> tuple[np.ndarray, int]:
    """The prefix of a set, and how many tokens of it a partner must share."""
    n, common = len(s), -(-len(s) * percent // 100)
    df = counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.float64)
    order = np.lexsort((s, df))
    others = np.maximum(0.0, df[order] - usual)
    spent = np.concatenate([[0.0], np.cumsum(others)])
    costs = [
        (length + spent[length] * (1 + COMPARE_COST / m), m)
        for m in MATCHES
        if m <= common and (length := n - common + m) <= n
    ]
    m = min(costs)[1]
    return s[order[: n - common + m]], m


def prefixes(docs: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """doc_id, n, m and prefix tokens of each row with words; ``counts`` is a broadcast."""

    def run(batches):
        let_go()
        table = counts.value
        usual = float(table.mean())
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingles(text.as_py(), size)
                if len(s) and doc_id.is_valid:
                    tokens, m = prefix(s, table, usual, percent)
                    out.append((doc_id.as_py(), len(s), m, tokens.view(np.int64)))
            yield from batches_of(
                out,
                ["doc", "n", "m", "tokens"],
                [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())],
            )

    return docs.mapInArrow(run, "doc long, n long, m int, tokens array<long>")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, judged on the whole texts."""

    def run(batches):
        let_go()
        held = None, None
        for batch in batches:
            out = []
            for a, b, x, y in zip(*batch.columns, strict=True):
                a, x = a.as_py(), x.as_py()
                if held[0] != (a, len(x)):
                    held = (a, len(x)), shingles(x, size)
                left, right = held[1], shingles(y.as_py(), size)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    out.append((a, b.as_py()))
            yield from batches_of(out, ["a", "b"], [pa.int64(), pa.int64()])

    texts = docs.select(F.col("doc_id"), F.col("text"))
    wide = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "x"}), "a")
    wide = wide.join(texts.withColumnsRenamed({"doc_id": "b", "text": "y"}), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _fits(percent: int):
    """Sizes so different that no overlap could do are left out."""
    return F.least("n", "n_other") * 100 >= F.greatest("n", "n_other") * percent


def few_partners(postings: DataFrame, percent: int) -> DataFrame:
    """For each document the partners that meet it under most tokens.

    Under each token every document meets two others only, the first one and one that a
    hash picks, so that the rows stay in proportion to the postings.
    """
    other = postings.select(
        "token", F.struct("doc", "n").alias("first"),
        F.struct(F.xxhash64("doc", "token").alias("h"), "doc", "n").alias("any"),
    )
    heads = other.groupBy("token").agg(F.min("first").alias("first"), F.min("any").alias("any"))
    met = postings.join(heads, "token").select(
        "doc", "n",
        F.inline(F.array(
            F.struct(F.col("first.doc").alias("other"), F.col("first.n").alias("n_other")),
            F.struct(F.col("any.doc").alias("other"), F.col("any.n").alias("n_other")),
        )),
    )
    met = met.where((F.col("doc") != F.col("other")) & _fits(percent))
    counted = met.groupBy("doc", "other").agg(F.count("*").alias("c"))
    best = F.slice(
        F.sort_array(F.collect_list(F.struct("c", "other")), asc=False), 1, PARTNERS
    )
    # a document meets at most two others per token of its prefix, which bounds the list
    chosen = counted.groupBy("doc").agg(best.alias("best"))
    pairs = chosen.select("doc", F.explode("best.other").alias("other"))
    return pairs.select(
        F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")
    ).distinct()


def all_partners(
    postings: DataFrame, labels: DataFrame, bitmaps: DataFrame, percent: int
) -> DataFrame:
    """All pairs of different classes whose prefixes meet and whose sets may be similar enough.

    A bit that is set in one bitmap only stands for a shingle that the other set lacks. So the
    number of such bits bounds the overlap from above, and a pair whose bound is below what its
    two sizes ask for is left out before it becomes a row. So is one that shares less than
    the lesser m, or than its two prefixes must share, as far as the numbers of tokens that
    each has in common with any other class tell. A document meets partners of its size and
    more under the early tokens of its prefix alone. ``bitmaps`` (doc, n, bitmap) may have
    several rows for an id that is repeated; what they add is left to the exact comparison.
    """
    known = postings.join(labels.withColumnRenamed("v", "doc"), "doc", "left").withColumn(
        "label", F.coalesce("label", "doc")
    )
    mixed = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = mixed.where("lo <> hi").select("token")
    left = known.join(mixed, "token", "left_semi")
    # how much a document can share at all: its tokens that another class has too
    own = left.groupBy("doc").agg(F.count("*").alias("most"))
    left = left.join(own, "doc").join(bitmaps, ["doc", "n"]).withColumn("rest", _after("n", "m", percent))
    right = left.select("token", *[F.col(c).alias(f"{c}_other") for c in _SIDE])
    smaller = (F.col("n") < F.col("n_other")) | (
        (F.col("n") == F.col("n_other")) & (F.col("doc") < F.col("doc_other"))
    )
    most = F.least("most", "most_other")
    met = left.where("early").join(right, "token").where(
        smaller
        & (F.col("label") != F.col("label_other"))
        & _fits(percent)
        & (most >= F.least("m", "m_other"))
        & _reaches(most, percent)
        & _overlaps(percent)
    )
    ends = F.least("doc", "doc_other").alias("a"), F.greatest("doc", "doc_other").alias("b")
    return met.select(*ends).distinct()


_SIDE = ("doc", "n", "m", "label", "most", "rest", *BITMAP)


def _overlaps(percent: int):
    """Whether the bitmaps leave room for the overlap that both sizes need."""
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_other"))) for w in BITMAP), F.lit(0))
    both = F.col("n") + F.col("n_other")
    return (both - apart) * (100 + percent) >= 2 * percent * both


def _lead(percent: int):
    """Last place of the part of a prefix that meets any partner of at least the same size.

    Such a partner shares at least 2 t / (1 + t) of the set.
    """
    least = F.ceil(2 * percent * F.col("n") / (100 + percent))
    return F.col("n") - least


def _reaches(common, percent: int):
    """Whether so many common prefix tokens leave room for the overlap that both sizes need."""
    bound = common + F.greatest("rest", "rest_other")
    return bound * (100 + percent) >= (F.col("n") + F.col("n_other")) * percent


def _after(n: str, m: str, percent: int):
    """Tokens of a set behind its prefix."""
    return F.ceil(F.col(n) * percent / 100).cast("long") - F.col(m)


def join_classes(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    work: Workspace | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    Words are split at white space and lower-cased in A-Z. A text of fewer than ``size``
    words is one shingle. Null texts and texts without words have no shingles, are linked with
    nothing and are their own component. A row without an id is counted, is linked with
    nothing and has a null component. Rows with one id are one document: a link of either
    is a link of both. Columns other than the two are not read.
    """
    spark: SparkSession = documents.sparkSession
    work = work or Workspace(spark, "ngram-join")
    docs = documents.select(
        col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")
    )
    signed = work.keep(signatures(docs, size), "signatures")
    counts = spark.sparkContext.broadcast(merged_counts(signed))
    rows = signed.where("piece is null").select("doc_id", "n", "fp")
    real = rows.where("n > 0 and doc_id is not null")
    first = real.groupBy("fp").agg(F.min("doc_id").alias("a"))
    copies = real.join(first, "fp").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    copies = work.keep(copies.distinct(), "copies")

    nodes = first.select(F.col("a").alias("doc")).distinct()
    heads = work.keep(
        prefixes(docs, counts, size, percent).join(nodes, "doc", "left_semi"), "prefixes"
    )
    tokens = heads.select(F.posexplode("tokens").alias("place", "token"), "doc", "n", "m")
    tokens = tokens.select("token", "doc", "n", "m", (F.col("place") <= _lead(percent)).alias("early"))
    shared = tokens.groupBy("token").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = work.keep(shared.where("lo <> hi").select("token"), "shared-tokens")
    postings = work.keep(tokens.join(shared, "token", "left_semi"), "postings")
    work.drop("prefixes")

    links = work.keep(verified(few_partners(postings, percent), docs, size, percent), "links")
    labels = components(copies.union(links), work, "first")
    bitmaps = signed.where("n > 0").select(F.col("doc_id").alias("doc"), "n", *BITMAP)
    pairs = work.keep(all_partners(postings, labels, bitmaps, percent), "pairs")
    more = work.keep(verified(pairs, docs, size, percent), "more-links")
    labels = components(copies.union(links).union(more), work, "last")
    labels = labels.withColumnsRenamed({"v": "doc_id", "label": "component_id"})
    return (
        rows.join(labels, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    )


def keep_first(documents: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row of each component stays: the document with the smallest id, once.

    Documents without words, and rows without an id, stay. Of repeated rows with one id
    the one whose text sorts first stays.
    """
    classes = join_classes(documents, work=work)
    names = documents.columns
    gone = classes.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    first = documents.join(gone, "doc_id", "left_anti")
    ids = documents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    again = ids.where("n > 1").select("doc_id")
    single = first.join(again, "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    number = "__n"
    while number in names:  # a name of the caller's is never replaced
        number += "_"
    repeated = first.join(again, "doc_id", "left_semi").withColumn(number, F.row_number().over(order))
    kept = single.unionByName(repeated.where(F.col(number) == 1).drop(number))
    return kept.select(*[col(c) for c in names])
