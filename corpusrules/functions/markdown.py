"""Column functions that write the report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NL

# Category folder and title per label.
CATEGORIES = {
    "business_logic": ("business-logic", "Business Logic"),
    "pipeline_code": ("pipeline-code", "Pipeline Code"),
}


def category(label: Column) -> Column:
    col = F.when(F.lit(False), F.lit(""))
    for value, (folder, _) in CATEGORIES.items():
        col = col.when(label == value, F.lit(folder))
    return col


def md_path(file_path: Column) -> Column:
    return F.regexp_replace(F.replace(file_path, F.lit("/"), F.lit("-")), r"\.(?:py|sql)\z", ".md")


def text_lines(*parts: Column | str) -> Column:
    """Parts joined by line breaks; a part that is null is left out."""
    return F.concat_ws(NL, *[F.lit(p) if isinstance(p, str) else p for p in parts])


def bullets(items: Column, mark: str = "") -> Column:
    """One list line per item, each item between ``mark``s."""
    return F.array_join(
        F.transform(items, lambda i: F.concat(F.lit(f"- {mark}"), i, F.lit(mark))), NL
    )


def section_if(condition: Column, *parts: Column | str) -> Column:
    """Lines and a blank line after them, or null."""
    return F.when(condition, text_lines(*parts, ""))


def source_link(repo_url: str | None, path: Column, start: Column, end: Column) -> Column:
    if not repo_url:
        return F.lit(None).cast("string")
    return F.concat(
        F.lit(f"[View Source]({repo_url}/blob/main/"),
        path, F.lit("#L"), start, F.lit("-L"), end, F.lit(")"),
    )


def parameter_table(parameters: Column) -> Column:
    rows = F.transform(
        parameters,
        lambda p: F.concat(
            F.lit("| `"), p["name"],
            F.lit("` | "), F.coalesce(p["type"], F.lit("-")),
            F.lit(" | "), F.coalesce(p["default"], F.lit("-")), F.lit(" |"),
        ),
    )
    return text_lines(
        "| Name | Type | Default |", "|------|------|---------|", F.array_join(rows, NL)
    )
