"""Phrase collocations: frequent phrases of 2 to 5 words that hold together more than chance.

Method: Toivonen's sampling algorithm for frequent phrases (contiguous word sequences).
1. Words are counted exactly; the frequent ones are the vocabulary. The texts are written once
   as runs of vocabulary numbers, since no frequent phrase holds another word.
2. A sample of the documents (``sample_fraction``, by ``DataFrame.sample``) proposes the
   phrases whose sample count reaches the lowered support ``sample_support * fraction *
   min_count``. That set is closed downwards: a part of a phrase occurs at least as often.
3. A full pass over all documents counts exactly every phrase whose first and last ``k - 1``
   words are both proposed (words: both frequent): the proposals and their negative border.
4. A border phrase that turns out frequent is a failure of the sample: the frequent phrases
   found join the proposals, and another full pass counts the phrases with such a part, until
   a pass finds no failure. Then every frequent phrase has been counted (its two parts are
   frequent, hence counted, hence proposed), so the result is exact.

Every task reads the written proposals into a table of bits (``Filter``, of bounded size), which
holds each of them and some other phrases: these are counted for nothing, since what is counted
is counted exactly and nothing proposed is missed. A task counts a million positions at a time,
level by level, so a phrase is formed only where both its parts are known and a very common
phrase is one row per block. The counts of a block leave the task as sorted, compressed chunks,
one for each of the tasks that add them up, so a row takes a few bytes of disk. A pass whose
chunks would take more than ``PASS_BYTES`` bytes a position, by those of the sample, is done in several
jobs, each for a share of the phrases, one after the other.

While the vocabulary has at most ``BROADCAST_ROWS`` rows, every task reads it. Beyond that size
phrases are exploded natively and filtered by semi joins with the proposals. Scores are exact
decimal integer arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rows import col
from .tables import Workspace

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
SAMPLE_FRACTION = 0.1
SAMPLE_SUPPORT = 0.7
SEED = 13
#: Vocabularies up to this many rows are read by every task; larger are joined.
BROADCAST_ROWS = 2_000_000
#: Bytes of text split at once, positions of written texts counted at once, rows sent at once.
SPLIT_BYTES = 2 << 20
POSITIONS = 1_000_000
ROWS_OUT = 100_000
#: Positions of the texts for each task that adds up counts, rows it holds before it adds them up.
POSITIONS_PER_TASK = 2_000_000
ROWS_HELD = 1_000_000
#: Bytes of disk for each position of the texts that the chunks of one job may take.
PASS_BYTES = 8
#: Bits of a filter, as powers of two: at least, at most (128 MB).
FILTER_BITS = 20, 30

# Fixed values of the contract: pieces end at these characters, words at blanks and tabs.
PIECE_ENDS = r"[.,;:!?\n\x0B\x0C\r]"
WORD_ENDS = r"[ \t]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

OUT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def word_pieces(docs: DataFrame) -> DataFrame:
    """(lang, ws): the words of every piece of every text; A-Z lower-cased, null lang ``und``."""
    text = F.translate(F.coalesce(col("text").cast("string"), F.lit("")), UPPER, LOWER)
    pieces = docs.select(
        F.coalesce(col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.explode(F.split(text, PIECE_ENDS, -1)).alias("piece"),
    )
    words = F.filter(F.split("piece", WORD_ENDS, -1), lambda w: w != "")
    return pieces.select("lang", words.alias("ws")).where(F.size("ws") > 0)


def _phrase(ws: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(ws, start, length), " ")


def phrases(pieces: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, k, g, pre, suf): every occurrence of 2 to ``longest`` words, with its first and
    last ``k - 1`` words."""
    size = F.size("ws")
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size - 1),
            lambda i: F.transform(
                F.sequence(F.lit(2), F.least(F.lit(longest), size - i + 1)),
                lambda k: F.struct(
                    k.alias("k"),
                    _phrase(F.col("ws"), i, k).alias("g"),
                    _phrase(F.col("ws"), i, k - 1).alias("pre"),
                    _phrase(F.col("ws"), i + 1, k - 1).alias("suf"),
                ),
            ),
        )
    )
    long_enough = pieces.where(size >= 2)
    return long_enough.select("lang", F.explode(grams).alias("o")).select("lang", "o.*")


_FOLDED = bytes.maketrans(
    (UPPER + ".,;:!?\x0b\x0c\r\t").encode(), (LOWER + "\n" * 9 + " ").encode()
)


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS_OUT):
        yield batch.slice(start, ROWS_OUT)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(col("text").cast("string"), F.lit("")).alias("text"),
    )


def _split(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(lang, words, piece of each word, row of each piece) of the texts of one lang, in blocks of
    about ``SPLIT_BYTES``; between neighbouring blanks stand empty words."""
    for lang in pc.unique(batch.column(0)):
        texts = batch.column(1).filter(pc.equal(batch.column(0), lang)).cast(pa.binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(offsets, offsets[start] + SPLIT_BYTES, side="right")) - 1
            stop = min(max(start + 1, stop), len(texts))
            first, last = int(offsets[start]), int(offsets[stop])
            # A-Z to a-z, piece ends to \n, tabs to blanks: byte for byte, so the offsets hold
            folded = data.slice(first, last - first).to_pybytes().translate(_FOLDED) if last > first else b""
            block = _binary(offsets[start : stop + 1] - first, folded)
            pieces = pc.split_pattern(block, b"\n")
            words = pc.split_pattern(pieces.flatten(), b" ")
            per_row = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
            per_piece = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            piece = np.repeat(np.arange(len(per_piece)), per_piece)
            yield lang.as_py(), words.flatten(), piece, np.repeat(np.arange(len(per_row)), per_row)
            start = stop


def words_counted(docs: DataFrame) -> DataFrame:
    """(lang, g, f) of every word; each task sends one row per word and block of texts."""

    def run(batches):
        for batch in batches:
            for lang, words, _, _ in _split(batch):
                counts = pc.value_counts(words)
                counts = counts.filter(pc.not_equal(counts.field(0), b""))
                langs = pa.array([lang] * len(counts), pa.string())
                columns = [langs, counts.field(0).cast(pa.string()), counts.field(1)]
                yield from _sent(pa.RecordBatch.from_arrays(columns, names=["lang", "g", "f"]))

    counted = _source(docs).mapInArrow(run, "lang string, g string, f long")
    return counted.groupBy("lang", "g").agg(F.sum("f").alias("f"))


def _dataset(path: str):
    """A written table, to be read by the task."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    filesystem, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return ds.dataset(base, filesystem=filesystem, format="parquet")


class Vocabulary:
    """The written frequent words, numbered from 1 in the order of (lang, word)."""

    def __init__(self, path: str):
        table = _dataset(path).to_table(["lang", "g"]).sort_by([("lang", "ascending"), ("g", "ascending")])
        self.langs = table.column("lang").combine_chunks()
        self.words = table.column("g").combine_chunks().cast(pa.binary())
        runs = pc.run_end_encode(self.langs)
        stops = runs.run_ends.to_pylist()
        self.range = dict(zip(runs.values.to_pylist(), zip([0, *stops], stops), strict=True))

    def numbers(self, lang: str, words: pa.Array) -> np.ndarray:
        """The words' numbers, 0 for a word that is not frequent, -1 for an empty one."""
        start, stop = self.range.get(lang, (0, 0))
        at = pc.index_in(words, value_set=self.words.slice(start, stop - start))
        found = pc.add(at, start + 1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        found[pc.equal(words, b"").to_numpy(zero_copy_only=False)] = -1
        return found


def _numbered(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(ids): per document the numbers (4 bytes each) of its runs of two frequent words and more,
    each run behind a 0."""

    def run(batches):
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(vocabulary_path)
            for lang, words, piece, row in _split(batch):
                ids = vocabulary.numbers(lang, words)
                ids, piece = ids[ids >= 0], piece[ids >= 0]
                joined = (ids[:-1] > 0) & (ids[1:] > 0) & (piece[:-1] == piece[1:])
                behind, before = np.append(False, joined), np.append(joined, False)
                kept = behind | before
                first = ~behind[kept]
                ids, owner = ids[kept], row[piece[kept]]
                out = np.zeros(len(ids) + int(first.sum()), np.int32)
                out[np.arange(len(ids)) + np.cumsum(first)] = ids
                rows = int(row[-1]) + 1
                sizes = np.bincount(owner, minlength=rows) + np.bincount(owner[first], minlength=rows)
                offsets = np.append(0, np.cumsum(4 * sizes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_binary(offsets, out.tobytes())], names=["ids"])

    return _source(docs).mapInArrow(run, "ids binary")


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The numbers of a batch of ``_numbered`` in blocks of about ``POSITIONS``, cut between runs."""
    ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
    zeros = np.flatnonzero(ids == 0)
    start = 0
    while start < len(ids):
        at = int(np.searchsorted(zeros, start + POSITIONS))
        stop = int(zeros[at]) if at < len(zeros) else len(ids)
        yield ids[start:stop].astype(np.int64)
        start = stop


def _by_length(g: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, words) of the phrases of each length; ``g`` holds the numbers of the words, 4 bytes each."""
    lengths = pc.binary_length(g).to_numpy(zero_copy_only=False) // 4
    for k in np.unique(lengths):
        rows = np.flatnonzero(lengths == k)
        words = np.frombuffer(b"".join(g.take(pa.array(rows)).to_pylist()), ">i4")
        yield rows, words.reshape(-1, k).astype(np.int32)


def _hashes(words: np.ndarray) -> np.ndarray:
    """64 bits for each row of word numbers."""
    found = np.full(len(words), words.shape[1], np.uint64)
    for column in words.T:
        found = (found ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    return found


def _dealt(hashes: np.ndarray, factor: int, n: int) -> np.ndarray:
    """One of ``n`` numbers for each hash; those of one factor say nothing about those of another."""
    return ((hashes * np.uint64(factor)) >> np.uint64(33)).astype(np.int64) % n


class Filter:
    """A set of phrases as two bits of a table for each: it holds all that were added, and a few
    others (less than 2 % of them, up to the greatest size of the table)."""

    def __init__(self, phrases: int):
        self.bits = min(max(FILTER_BITS[0], (16 * phrases).bit_length()), FILTER_BITS[1])
        self.table = np.zeros(1 << self.bits >> 3, np.uint8)

    def _at(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        other = (hashes * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - self.bits)
        for at in (hashes & np.uint64((1 << self.bits) - 1), other):
            yield (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for byte, bit in self._at(hashes):
            for b in range(8):
                self.table[byte[bit == b]] |= np.uint8(1 << b)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for byte, bit in self._at(hashes):
            found &= (self.table[byte] >> bit) & 1 > 0
        return found


class Proposals:
    """The written proposals and those of them that are new to a pass, as filters."""

    def __init__(self, path: str, phrases: int, new: int):
        self.known, self.fresh = Filter(phrases), Filter(new)
        read = _dataset(path).to_batches(
            columns=["g", "fresh"], batch_size=ROWS_OUT, batch_readahead=1, fragment_readahead=1, use_threads=False
        )
        for batch in read:
            fresh = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, words in _by_length(batch.column(0)):
                hashes = _hashes(words)
                self.known.add(hashes)
                self.fresh.add(hashes[fresh[rows]])


def _block_counts(
    ids: np.ndarray, base: int, longest: int, proposals: Proposals | None, again: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, hashes, counts) of the phrases of each length in one block, sorted by their first
    ``k - 1`` words' numbers in the block: those whose two parts the proposals hold (without
    ``proposals`` all), with ``again`` only where one of the parts is new."""
    level, words, fresh = ids, None, None
    for k in range(2, longest + 1):
        formed = (level[:-1] > 0) & (level[1:] > 0)
        if not formed.any():
            return
        codes = level[:-1][formed] * base + ids[k - 1 :][formed]
        found, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
        head, last = found // base, (found % base).astype(np.int32)
        words_now = np.column_stack([head.astype(np.int32) if k == 2 else words[head - 1], last])
        hashes = _hashes(words_now)
        wanted = np.ones(len(found), bool)
        if again:
            wanted[:] = False
            if k > 2:
                new = fresh[level[:-1][formed] - 1] | fresh[level[1:][formed] - 1]
                wanted[back[new]] = True
        if wanted.any():
            yield words_now[wanted], hashes[wanted], counts[wanted]
        words, numbers = words_now, np.arange(1, len(found) + 1)
        if proposals is not None:
            numbers[~proposals.known.holds(hashes)] = 0
            fresh = proposals.fresh.holds(hashes)
        level = np.zeros(len(formed), np.int64)
        level[formed] = numbers[back]


def _packed(words: np.ndarray, counts: np.ndarray) -> bytes:
    """Phrases of one length and their counts, compressed: steps between first words, the other
    words, the counts; of each first all lowest bytes, then all second ones and so on."""
    columns = np.empty((words.shape[1] + 1, len(words)), np.int32)
    columns[0] = np.diff(words[:, 0], prepend=np.int32(0))
    columns[1:-1] = words[:, 1:].T
    columns[-1] = counts
    planes = columns.view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(k: int, n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of ``_packed``, a column for each phrase."""
    planes = pa.decompress(data, decompressed_size=4 * (k + 1) * n, codec="zstd", asbytes=True)
    columns = np.frombuffer(planes, np.uint8).reshape(k + 1, 4, n).transpose(0, 2, 1)
    columns = columns.copy(order="C").view(np.int32)[:, :, 0]
    columns[0] = np.cumsum(columns[0])
    return columns[:k], columns[k].astype(np.int64)


def _chunks(
    numbered: DataFrame,
    base: int,
    longest: int,
    tasks: int,
    proposals: tuple[str, int, int] | None = None,
    again: bool = False,
    share: int = 0,
    shares: int = 1,
) -> DataFrame:
    """(part, k, n, data): the counts of ``_block_counts``, ``_packed`` for each of ``tasks`` parts;
    the phrases of one of the ``shares`` only. ``proposals`` are the arguments of ``Proposals``."""
    names = ["part", "k", "n", "data"]

    def run(batches):
        held = None
        for batch in batches:
            if proposals and held is None:
                held = Proposals(*proposals)
            for ids in _blocks(batch):
                for words, hashes, counts in _block_counts(ids, base, longest, held, again):
                    if shares > 1:
                        mine = _dealt(hashes, 0x165667B19E3779F9, shares) == share
                        words, hashes, counts = words[mine], hashes[mine], counts[mine]
                    part = _dealt(hashes, 0x27D4EB2F165667C5, tasks).astype(np.int32)
                    order = np.argsort(part, kind="stable")
                    words, counts = words[order], counts[order]
                    parts, starts, sizes = np.unique(part[order], return_index=True, return_counts=True)
                    data = [
                        _packed(words[a : a + n], counts[a : a + n]) for a, n in zip(starts, sizes, strict=True)
                    ]
                    columns = [parts, np.full(len(parts), words.shape[1], np.int32), sizes.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, columns), pa.array(data, pa.binary())], names=names
                    )

    return numbered.mapInArrow(run, "part int, k int, n int, data binary")


def _added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of one length, each once, with the sums of their counts."""
    words = np.concatenate([w for w, _ in held], axis=1)
    counts = np.concatenate([c for _, c in held])
    keys = [f"w{j}" for j in range(len(words))]
    table = pa.table([*map(pa.array, words), pa.array(counts)], names=[*keys, "f"])
    found = table.group_by(keys, use_threads=False).aggregate([("f", "sum")])
    return np.stack([found[c].to_numpy() for c in keys]), found["f_sum"].to_numpy()


def _sums(chunks: DataFrame, tasks: int, least: int) -> DataFrame:
    """(g, f) of the phrases of ``_chunks`` counted ``least`` times or more; ``g`` holds the numbers
    of the words, 4 bytes each."""

    def run(batches):
        held, rows, most = {}, {}, {}
        for batch in batches:
            for k, n, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                held.setdefault(k, []).append(_unpacked(k, n, data))
                rows[k] = rows.get(k, 0) + n
                if rows[k] > most.get(k, ROWS_HELD):
                    held[k] = [_added_up(held[k])]
                    rows[k] = len(held[k][0][1])
                    most[k] = max(ROWS_HELD, 2 * rows[k])
        for k in list(held):
            words, counts = _added_up(held.pop(k))
            kept = counts >= least
            words = np.ascontiguousarray(words[:, kept].T.astype(">i4"))
            g = _binary(np.arange(0, 4 * words.size + 1, 4 * k), words.tobytes())
            yield from _sent(pa.RecordBatch.from_arrays([g, pa.array(counts[kept])], names=["g", "f"]))

    return chunks.repartitionById(tasks, F.col("part")).mapInArrow(run, "g binary, f long")


def _spelled(found: DataFrame, vocabulary_path: str) -> DataFrame:
    """(lang, k, g, f): phrases of numbers as words."""

    def run(batches):
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(vocabulary_path)
            for rows, ids in _by_length(batch.column(0)):
                ids, k = ids - 1, ids.shape[1]
                words = [vocabulary.words.take(pa.array(ids[:, j])).cast(pa.string()) for j in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [
                        vocabulary.langs.take(pa.array(ids[:, 0])),
                        pa.array(np.full(len(ids), k), pa.int32()),
                        pc.binary_join_element_wise(*words, " "),
                        batch.column(1).take(pa.array(rows)),
                    ],
                    names=["lang", "k", "g", "f"],
                )

    return found.mapInArrow(run, "lang string, k int, g string, f long")


def _joined(
    docs: DataFrame, vocabulary: DataFrame, min_count: int, longest: int, fraction: float, lowered: int, work: Workspace
) -> tuple[DataFrame, int]:
    """``frequent_phrases`` for sets no task should hold: phrases are joined with the proposals."""
    grams = phrases(word_pieces(docs), longest)
    drawn = phrases(word_pieces(docs.sample(fraction=fraction, seed=SEED)), longest)
    proposals = drawn.groupBy("lang", "k", "g").agg(F.count("*").alias("f")).where(F.col("f") >= lowered)
    words = vocabulary.select("lang", F.lit(1).alias("k"), "g", "f")
    proposed = work.keep(words.unionByName(proposals).select("lang", "k", "g"), "joined0")
    passes = 0
    while True:
        passes += 1
        known = proposed.select("lang", F.col("g").alias("part"))
        kept = grams.join(known.withColumnRenamed("part", "pre"), ["lang", "pre"], "left_semi")
        kept = kept.join(known.withColumnRenamed("part", "suf"), ["lang", "suf"], "left_semi")
        counted = kept.groupBy("lang", "k", "g").agg(F.count("*").alias("f")).where(F.col("f") >= min_count)
        found = work.keep(words.unionByName(counted), f"counted{passes}")
        failures = found.join(proposed, ["lang", "k", "g"], "left_anti")
        if failures.limit(1).count() == 0:
            return found, passes
        proposed = work.keep(proposed.unionByName(failures.select("lang", "k", "g")), f"joined{passes}")


def _mined(
    docs: DataFrame, min_count: int, longest: int, fraction: float, support: float, work: Workspace
) -> tuple[DataFrame, int, DataFrame]:
    """The frequent phrases, the number of full passes over the phrases, and (lang, n)."""
    counted = work.keep(words_counted(docs), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = work.keep(counted.where(F.col("f") >= min_count), "vocabulary")
    lowered = max(1, int(support * fraction * min_count))
    size = vocabulary.count()
    if size > BROADCAST_ROWS:
        return *_joined(docs, vocabulary, min_count, longest, fraction, lowered, work), totals
    base = size + 1
    vocabulary_path = f"{work.home}/vocabulary"
    numbered = work.keep(_numbered(docs, vocabulary_path), "numbered")
    drawn = numbered.sample(fraction=fraction, seed=SEED)
    positions = totals.agg(F.sum("n")).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, math.ceil(positions / POSITIONS_PER_TASK))
    sample = _sums(_chunks(drawn, base, longest, tasks), tasks, lowered)
    name = "proposed0"
    proposed = work.keep(sample.select("g", F.lit(False).alias("fresh")), name)
    passes, parts, shares = 0, [], 1
    while True:
        new = proposed.where("fresh").count()
        if passes and not new:
            break
        passes += 1
        given = f"{work.home}/{name}", proposed.count(), new
        if passes == 1:
            size = _chunks(drawn, base, longest, tasks, given).agg(F.sum(F.length("data"))).first()[0] or 0
            shares = max(1, math.ceil(size / fraction / (PASS_BYTES * max(1, positions))))
        counted = []
        for share in range(shares):
            chunks = _chunks(numbered, base, longest, tasks, given, passes > 1, share, shares)
            counted.append(work.keep(_sums(chunks, tasks, min_count), f"frequent{passes}_{share}"))
        parts += counted
        found = reduce(DataFrame.unionByName, counted)
        failures = found.where(F.length("g") < 4 * longest).join(proposed, "g", "left_anti")
        grown = proposed.select("g", F.lit(False).alias("fresh")).unionByName(
            failures.select("g", F.lit(True).alias("fresh"))
        )
        name = f"proposed{passes}"
        proposed = work.keep(grown, name)
    # a phrase that a filter held by chance may have been counted in two passes
    every = reduce(DataFrame.unionByName, parts).distinct()
    words = vocabulary.select("lang", F.lit(1).alias("k"), "g", "f")
    return work.keep(words.unionByName(_spelled(every, vocabulary_path)), "frequent"), passes, totals


def frequent_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    sample_fraction: float = SAMPLE_FRACTION,
    sample_support: float = SAMPLE_SUPPORT,
    work: Workspace | None = None,
) -> tuple[DataFrame, int]:
    """(lang, k, g, f) of every phrase of 1 to ``longest`` words counted ``min_count`` times or
    more, exactly, and the number of full passes it took."""
    work = work or Workspace(docs.sparkSession, "collocations")
    found, passes, _ = _mined(docs, min_count, longest, sample_fraction, sample_support, work)
    return found, passes


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    longest: int = LONGEST,
    sample_fraction: float = SAMPLE_FRACTION,
    sample_support: float = SAMPLE_SUPPORT,
) -> DataFrame:
    """``OUT``: per lang the ``top`` phrases of 2 to ``longest`` words by score.

    ``a`` is a phrase's count, ``n`` the lang's number of words; each cut after ``k`` words
    gives ``l``, ``r`` (counts of the two parts) and ``floor(1000 a n / (l r))``; the lowest
    score counts, ties to the smallest ``k``. A phrase is left out when it lies inside a longer
    frequent phrase of the same count. Order: score, then ``a`` descending, then the phrase
    by UTF-8 bytes. A null text has no words, a null lang is ``und``; other columns of ``docs``
    are not read, so their names do not matter. Repeated rows count each time. A lang
    without frequent phrases, or an empty table, gives no rows.
    """
    work = Workspace(docs.sparkSession, "collocations")
    frequent, _, totals = _mined(docs, min_count, longest, sample_fraction, sample_support, work)
    candidates = frequent.where(F.col("k") >= 2).select(
        "lang", F.col("g").alias("phrase"), F.col("f").alias("a"), F.split("g", " ").alias("ws")
    )
    parts = frequent.select("lang", F.col("g").alias("part"), F.col("f").alias("count"))
    cuts = candidates.select(
        "lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("cut")
    ).select(
        "lang",
        "phrase",
        "a",
        "cut",
        _phrase(F.col("ws"), F.lit(1), F.col("cut")).alias("left"),
        _phrase(F.col("ws"), F.col("cut") + 1, F.size("ws") - F.col("cut")).alias("right"),
    )
    cuts = cuts.join(
        parts.select("lang", F.col("part").alias("left"), F.col("count").alias("l")), ["lang", "left"]
    ).join(parts.select("lang", F.col("part").alias("right"), F.col("count").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    big = "decimal(38,0)"
    score = F.expr(
        f"(cast(1000 as {big}) * cast(a as {big}) * cast(n as {big})) div (cast(l as {big}) * cast(r as {big}))"
    )
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r"))).alias("b")
    )
    inside = candidates.where(F.size("ws") >= 3).select(
        "lang",
        "a",
        "ws",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.size("ws") - 1),
                    lambda k: F.transform(
                        F.sequence(F.lit(1), F.size("ws") - k + 1), lambda i: _phrase(F.col("ws"), i, k)
                    ),
                )
            )
        ).alias("phrase"),
    )
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") < F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(
        F.col("b.score").desc(), F.col("a").desc(), F.col("phrase").asc()
    )
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        F.col("a").cast("long").alias("a"),
        F.col("b.l").cast("long").alias("l"),
        F.col("b.r").cast("long").alias("r"),
        F.col("n").cast("long").alias("n"),
        F.col("b.score").cast("long").alias("score"),
    )
