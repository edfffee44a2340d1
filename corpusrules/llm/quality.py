"""Quality rules as a bitmask ledger, in native columns.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; a policy is a mask over the bits, so another version of the policy, or the
effect of leaving a rule out, needs the ledger only, not the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import col

WHITE = "\\x20\\x09-\\x0D"

#: Rule names in bit order, with the condition that fails a document, in whole numbers.
RULES = (
    ("short", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("same_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("capitals", "100 * n_upper > 40 * word_chars"),
    ("exclaims", "n_exclaims > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
POLICIES = {
    "base": BIT["short"] | BIT["repeats"],
    "v1": BIT["short"] | BIT["repeats"] | BIT["symbols"] | BIT["same_lines"],
    "v2": sum(BIT.values()),
}
POLICY = "v2"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper",
    "n_exclaims",
)


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns ``MEASURES``; null and empty texts measure 0 throughout.

    Columns of ``df`` with these names, or with names that begin with ``__q_``, are replaced.
    Word windows are compared by 64-bit hash; a window that occurs again is found by sorting
    (hash, place), so a text of n words costs n log n. No shuffle.
    """
    drop = [c for c in df.columns if c in MEASURES or c.startswith("__q_")]
    names = ("text", "words", "windows", "pairs", "places")
    text, words, windows, pairs, places = (F.col(f"__q_{x}") for x in names)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{WHITE}]"))
    kept = df.drop(*[c for c in drop if c != text_col])
    out = kept.withColumn("__q_text", F.coalesce(col(text_col).cast("string"), F.lit("")))
    out = out.withColumns(
        {
            "__q_words": F.array_remove(F.split(text, f"[{WHITE}]+", -1), ""),
            "__q_lines": lines,
        }
    )
    out = out.withColumn(
        "__q_windows",
        F.when(
            F.size(words) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            ),
        ),
    )
    # most texts repeat no window: only the others are sorted
    out = out.withColumn(
        "__q_pairs",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def again(x, j):
        return F.get(pairs, j - 1)["h"].eqNullSafe(x["h"]) | F.get(pairs, j + 1)["h"].eqNullSafe(x["h"])

    out = out.withColumn(
        "__q_places", F.sort_array(F.transform(F.filter(pairs, again), lambda x: x["i"]))
    )
    covered = F.transform(
        places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3)))
    )
    measures = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _count(text, "#*$%&|<>"),
        "n_lines": F.size("__q_lines").cast("long"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(_sum(covered), F.lit(0)).cast("long"),
        "n_upper": _count(text, "A-ZÀ-ÖØ-Þ"),
        "n_exclaims": _count(text, "!"),
    }
    names = [c for c in kept.columns if c not in MEASURES]
    return out.select(*[col(c) for c in names], *[c.alias(n) for n, c in measures.items()])


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``measure(df)`` with ``failed long``: bit i is set where rule i fails the document."""
    measured = measure(df, text_col)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def apply_policy(entries: DataFrame, version: str = POLICY) -> DataFrame:
    """A ledger with ``kept``: no rule of the policy fails."""
    mask = F.lit(POLICIES[version]).cast("long")
    return entries.withColumn("kept", F.col("failed").bitwiseAND(mask) == 0)


def ablate(entries: DataFrame, *by: str, version: str = POLICY) -> DataFrame:
    """Per rule of a policy (and ``by``): rows it fails, and rows that only it rejects.

    The ledger is first counted per distinct set of bits, at most 2 ** rules rows for each
    ``by``; rules are told apart on those counts. ``n_rows`` and ``n_kept`` come along.
    """
    mask = POLICIES[version]
    bits = F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")
    counts = entries.groupBy(*by, bits).agg(F.count("*").alias("n"))
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"))
            for name, bit in BIT.items()
            if bit & mask
        ]
    )
    each = counts.select(*by, "bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    return each.groupBy(*by, "rule").agg(
        F.sum("n").alias("n_rows"),
        rows(F.col("bits") == 0).alias("n_kept"),
        rows(hit).alias("n_failed"),
        rows(F.col("bits") == F.col("bit")).alias("n_only"),
    )


def masks(entries: DataFrame, *by: str) -> DataFrame:
    """Per ``by``: bits that some, all, and an odd number of rows fail."""
    return entries.groupBy(*by).agg(
        F.bit_or("failed").alias("some"),
        F.bit_and("failed").alias("every"),
        F.bit_xor("failed").alias("odd"),
    )


def keep_good(df: DataFrame, text_col: str = "text", version: str = POLICY) -> DataFrame:
    """Rows of ``df`` that the policy keeps, with their own columns."""
    names = df.columns
    marked = df.select(*[col(c).alias(f"__{i}") for i, c in enumerate(names)])
    judged = apply_policy(ledger(marked, f"__{names.index(text_col)}"), version)
    # a number per row keeps the optimiser from moving the filter below the measurements,
    # which would write each of them out anew wherever a rule names it
    once = F.monotonically_increasing_id() >= 0
    judged = judged.withColumn("kept", F.col("kept") & once).where("kept")
    return judged.select(*[col(f"__{i}").alias(c) for i, c in enumerate(names)])
