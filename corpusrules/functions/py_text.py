"""Column functions over the text of Python functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NL, REST_OF_LINE, WS, extract_all, strip

# Parameter names that are never reported.
RECEIVERS = ("self", "cls")

_QUOTES = "'''|\"\"\"|'|\""


def docstring(literal: Column) -> Column:
    """Text of a string literal; prefix letters stop the opening quotes from being cut."""
    opened = F.regexp_replace(literal, rf"^(?:{_QUOTES})", "")
    return strip(F.regexp_replace(opened, rf"(?:{_QUOTES})\z", ""))


def without_receivers(parameters: Column) -> Column:
    return F.filter(parameters, lambda p: ~p["name"].isin(*RECEIVERS))


def py_signature(name: Column, parameters: Column, return_type: Column) -> Column:
    def one(p: Column) -> Column:
        return F.concat(
            p["name"],
            F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")),
            F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")),
        )

    return F.concat(
        F.lit("def "),
        name,
        F.lit("("),
        F.array_join(F.transform(parameters, one), ", "),
        F.lit(")"),
        F.coalesce(F.concat(F.lit(" -> "), return_type), F.lit("")),
    )


def py_markers(source: Column, doc: Column, doc_literal: Column, doc_offset: Column) -> Column:
    """Rule markers of the docstring, then of the source around the docstring."""
    around = F.when(
        doc_literal.isNotNull(),
        F.concat(
            F.substring(source, F.lit(1), doc_offset),
            F.substring(source, doc_offset + F.length(doc_literal) + 1, F.length(source)),
        ),
    ).otherwise(source)
    text = F.concat(F.coalesce(doc, F.lit("")), F.lit(NL), around)
    pattern = rf"(?i)BUSINESS_RULE{WS}*[:=]?{WS}*({REST_OF_LINE}++)(?:\n|\z)"
    return F.transform(extract_all(text, pattern), strip)
