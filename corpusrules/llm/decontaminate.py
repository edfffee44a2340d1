"""Benchmark decontamination: Wu-Manber search for benchmark passages, on words.

The patterns are all windows of ten words of each item (an item of fewer words is one
pattern). Per pattern length, a shift table keyed by blocks of words tells how far
the end of the window may jump; where it may not jump, the suffix bucket of the block holds
the patterns that end so, and each is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import add_columns, col

WINDOW = 10
BLOCK = 3
#: Pattern words in one pass; more benchmark than this is searched in several passes.
BLOCK_WORDS = 4_000_000

#: 0-9, a-z and all bytes of characters beyond ASCII stay, A-Z become a-z, the rest separates.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or b >= 0x61 and b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))]


class Searcher:
    """Tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.furthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, length), length - end)
            self.bucket.setdefault(pattern[-self.block :], []).append((pattern, items))

    def find(self, text: list[bytes]):
        """(place of the last word, items) of each occurrence."""
        m, shift, furthest = self.length, self.shift.get, self.furthest
        at, n = m - 1, len(text)
        if self.block == 3:
            while at < n:
                jump = shift((text[at - 2], text[at - 1], text[at]), furthest)
                if jump:
                    at += jump
                    continue
                yield from self.compare(text, at)
                at += 1
        else:
            size = self.block
            while at < n:
                jump = shift(tuple(text[at - size + 1 : at + 1]), furthest)
                if not jump:
                    yield from self.compare(text, at)
                at += jump or 1

    def compare(self, text: list[bytes], at: int):
        start = at - self.length + 1
        first = text[start]
        for pattern, items in self.bucket[tuple(text[at - self.block + 1 : at + 1])]:
            if pattern[0] == first and pattern == tuple(text[start : at + 1]):
                yield at, items


def searchers(items: list[tuple[str, str | None]]) -> list[Searcher]:
    """One for each length of pattern among (item id, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item_id, text in items:
        for pattern in windows(words(text)):
            owners = by_length.setdefault(len(pattern), {}).setdefault(pattern, [])
            if not owners or owners[-1] != item_id:
                owners.append(item_id)
    return [Searcher(length, patterns) for length, patterns in sorted(by_length.items())]


def search(text: list[bytes], tables: list[Searcher]) -> tuple[bytearray, set[str]]:
    """Which words are hit, and by which items."""
    hit, found = bytearray(len(text)), set()
    for table in tables:
        covered = 0
        for at, items in table.find(text):
            start = max(covered, at - table.length + 1)
            hit[start : at + 1] = b"\x01" * (at + 1 - start)
            covered = at + 1
            found.update(items)
    return hit, found


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """The items in blocks of bounded size, each fetched when it is needed.

    The number of blocks follows the size of the table; a block is the items of one hash class.
    Items without an id or text take no part.
    """
    items = benchmark.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text"))
    items = items.where("id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size * WINDOW // (6 * block_words)))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield [tuple(r) for r in part.orderBy("id", "text").collect()]


def find_items(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``documents`` with n_words, hit (one byte per word), items (ids as strings, sorted).

    A null or empty text has no words and no hits; an empty benchmark hits nothing. Repeated
    rows are searched each for itself. No shuffle: one pass per block of the benchmark
    hands its tables to the tasks and adds its hits to those of the passes before.
    """
    out = documents
    spark = documents.sparkSession
    for number, block in enumerate(item_blocks(benchmark, id_col, item_text, block_words)):
        shared = spark.sparkContext.broadcast(block)
        out = _one_pass(out, text_col, shared, first=number == 0)
    return out


def _one_pass(df: DataFrame, text_col: str, shared, first: bool) -> DataFrame:
    def make():
        tables = searchers(shared.value)

        def one(text):
            ws = words(text)
            hit, found = search(ws, tables)
            return len(ws), bytes(hit), sorted(found)

        return one

    schema = "n_words long, hit binary, items array<string>"
    if first:
        return add_columns(df, text_col, schema, make)
    held = df.withColumnsRenamed({"hit": "__hit", "items": "__items"})
    more = add_columns(held, text_col, schema, make)
    merged = F.transform(
        F.sequence(F.lit(1), F.length("hit")),
        lambda i: F.greatest(F.hex(F.substring("hit", i, F.lit(1))), F.hex(F.substring("__hit", i, F.lit(1)))),
    )
    merged = F.when(F.length("hit") > 0, F.unhex(F.array_join(merged, ""))).otherwise(F.col("hit"))
    return more.withColumns(
        {"hit": merged, "items": F.array_sort(F.array_union("items", "__items"))}
    ).drop("__hit", "__items")


def report(found: DataFrame) -> DataFrame:
    """``find_items`` as numbers: n_hit, n_items, items_sha256, contaminated in place of spans."""
    n_hit = F.length(F.replace(F.hex("hit"), F.lit("00"), F.lit(""))) / 2
    return found.withColumns(
        {
            "n_hit": n_hit.cast("long"),
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
            "contaminated": n_hit > 0,
        }
    ).drop("hit", "items")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no pattern occurs, with their own columns."""
    kept = documents.columns
    marked = documents.select(*[col(c).alias(f"__{i}") for i, c in enumerate(kept)])
    text = f"__{kept.index('text')}"
    found = find_items(marked, benchmark, text).where(F.size("items") == 0)
    return found.select(*[col(f"__{i}").alias(c) for i, c in enumerate(kept)])

