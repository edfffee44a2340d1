"""Pattern scores: how many of a fixed list of patterns occur in a text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import REST_OF_LINE, matches

# Fixed values. All are searched without regard to case.
BUSINESS_PATTERNS = (
    r"threshold",
    r"limit",
    r"calculate.*(?:rag|status|score)",
    r"validate",
    r"check.*(?:rule|condition|constraint)",
    r"(?:red|amber|green)",
    r"percentage",
    r"rate.*(?:increase|decrease)",
    r"rule",
    r"policy",
    r"eligibility",
    r"compliance",
    r"sla",
    r"kpi",
    r"metric",
)
PIPELINE_PATTERNS = (
    r"^(?:load|read|write|save)_",
    r"^(?:extract|transform|ingest)",
    r"^(?:setup|init|configure|connect)",
    r"spark\.read",
    r"\.write\.",
    r"\.save\(",
    r"\.load\(",
    r"pd\.read",
    r"to_(?:csv|parquet|json)",
    r"get_(?:connection|session|client)",
    r"create_(?:table|database|schema)",
)

# ^?  plain text  (?:choice|choice)?  plain text -- a list of words, no search needed
_WORD_LIST = re.compile(r"(\^?)((?:\w|\\.)*)(?:\(\?:([\w|]+)\))?((?:\w|\\.)*)")


def fold(text: Column) -> Column:
    """ASCII case folding.

    The only two other characters whose lower case holds an ASCII letter are
    taken out first, so lower() cannot turn foreign text into a match.
    """
    for c in ("\u0130", "\u212a"):
        text = F.replace(text, F.lit(c), F.lit("?"))
    return F.lower(text)


def occurs(folded: Column, pattern: str) -> Column:
    """True if ``pattern`` (lower case) occurs in a folded text.

    Word lists become substring tests; only patterns with a gap stay regular
    expressions, behind a substring test for the text in front of the gap.
    """
    words = _WORD_LIST.fullmatch(pattern)
    if words is None:
        head, gap, tail = pattern.partition(".*")
        return F.contains(folded, F.lit(head)) & matches(folded, f"{head}{REST_OF_LINE}*{tail}")
    anchor, before, choices, after = words.groups()
    test = F.startswith if anchor else F.contains
    tests = [
        test(folded, F.lit(re.sub(r"\\(.)", r"\1", before + choice + after)))
        for choice in (choices or "").split("|")
    ]
    return reduce(lambda a, b: a | b, tests)


def score(folded: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [occurs(folded, p).cast("int") for p in patterns])


def unit_text(name: Column, source: Column, description: Column) -> Column:
    """The text a unit is scored on; its start is the name."""
    return F.concat(
        name, F.lit(" "), source, F.lit(" "), F.coalesce(description, F.lit(""))
    )
