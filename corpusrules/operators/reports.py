"""Reports over classified units.

Documents whose length grows with the corpus come out as rows with sort keys,
never as one text: a page of a file is a header and chunks of at most
``UNITS_PER_CHUNK`` units, an index is one row per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions.text import NL, basename, first_line

UNITS_PER_CHUNK = 1000
PAGE_ORDER = ("category", "md_path", "kind", "file_path", "chunk")
INDEX_ORDER = ("category", "part", "file_path", "ordinal")
_HEADER = -1
_AFTER_ALL = 2**31 - 1


def _has(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def _verdict_line() -> Column:
    return F.concat(
        F.lit("*Classification: "), F.col("classification"),
        F.lit(" ("), F.col("confidence"), F.lit(" confidence)*"),
    )


def _description_and_rules() -> tuple[Column, Column]:
    description, markers = F.col("description"), F.col("markers")
    return (
        M.section_if(_has(description), "### Description", description),
        M.section_if(F.size(markers) > 0, "### Business Rules", M.bullets(markers)),
    )


def function_section(repo_url: str | None = None) -> Column:
    parameters, decorators, returns = F.col("parameters"), F.col("decorators"), F.col("return_type")
    link = M.source_link(repo_url, F.col("file_path"), F.col("start_line"), F.col("end_line"))
    return M.text_lines(
        "",
        F.concat(F.lit("## "), F.col("name")),
        "",
        M.section_if(link.isNotNull(), link),
        "### Signature", "```python", F.col("signature"), "```", "",
        *_description_and_rules(),
        M.section_if(F.size(parameters) > 0, "### Parameters", M.parameter_table(parameters)),
        M.section_if(_has(returns), "### Returns", F.concat(F.lit("- `"), returns, F.lit("`"))),
        M.section_if(F.size(decorators) > 0, "### Decorators", M.bullets(decorators, "`")),
        _verdict_line(),
        F.concat(F.lit("*Reason: "), F.col("reason"), F.lit("*")),
        "",
        "---",
    )


def sql_section() -> Column:
    return M.text_lines(
        "",
        F.concat(F.lit("## "), F.col("name")),
        "",
        F.concat(F.lit("**Type:** "), F.col("sql_type")),
        "",
        *_description_and_rules(),
        M.section_if(
            F.size("tables") > 0, "### Tables Referenced", M.bullets(F.col("tables"), "`")
        ),
        "### Source", "```sql", F.col("source_code"), "```", "",
        _verdict_line(),
        "",
        "---",
    )


def _pages(units: DataFrame, section: Column) -> DataFrame:
    path = F.col("file_path")
    keyed = units.select(
        M.category(F.col("classification")).alias("category"),
        "kind",
        "file_path",
        F.floor(F.col("ordinal") / UNITS_PER_CHUNK).cast("int").alias("chunk"),
        "ordinal",
        section.alias("section"),
    )
    page = ("category", "kind", "file_path")
    chunks = keyed.groupBy(*page, "chunk").agg(
        F.expr("listagg(section, chr(10)) within group (order by ordinal)").alias("body")
    )
    header = M.text_lines(
        F.concat(F.lit("# "), basename(path)),
        "",
        F.concat(F.lit("**File:** `"), path, F.lit("`")),
        "",
        "---",
    )
    headers = (
        units.select(M.category(F.col("classification")).alias("category"), "kind", "file_path")
        .distinct()
        .select(*page, F.lit(_HEADER).alias("chunk"), header.alias("body"))
    )
    return headers.unionByName(chunks).withColumn("md_path", M.md_path(path))


def function_pages(units: DataFrame, repo_url: str | None = None) -> DataFrame:
    """Page of the functions of one file in one category: header, then chunks."""
    return _pages(units.filter(F.col("kind") == "function"), function_section(repo_url))


def sql_pages(units: DataFrame) -> DataFrame:
    """Page of the SQL blocks of one file in one category: header, then chunks."""
    return _pages(units.filter(F.col("kind") == "sql"), sql_section())


def pages(units: DataFrame, repo_url: str | None = None) -> DataFrame:
    """All pages: ``(category, kind, file_path, md_path, chunk, body)``."""
    return function_pages(units, repo_url).unionByName(sql_pages(units))


def _count(label: str | None, kind: str) -> Column:
    test = F.col("kind") == kind
    if label is not None:
        test = test & (F.col("classification") == label)
    return F.count_if(test)


def category_index(units: DataFrame) -> DataFrame:
    """Index of each category as lines; sorted by ``INDEX_ORDER`` they are the document.

    Parts: 0 head, 1 and 3 headings of the two kinds, 2 and 4 their files.
    """
    counts = units.agg(
        *[
            _count(label, kind).alias(f"{kind}_{label}")
            for label in M.CATEGORIES
            for kind in ("function", "sql")
        ]
    )

    def line(folder: str, part: int, at: int, text: Column, present: Column) -> Column:
        return F.when(
            present,
            F.struct(
                F.lit(folder).alias("category"),
                F.lit(part).alias("part"),
                F.lit("").alias("file_path"),
                F.lit(at).alias("ordinal"),
                text.alias("line"),
            ),
        )

    head = []
    for label, (folder, title) in M.CATEGORIES.items():
        n_functions, n_sql = F.col(f"function_{label}"), F.col(f"sql_{label}")
        texts = [
            F.lit(f"# {title} Documentation"),
            F.lit(""),
            F.lit(
                "This directory contains auto-generated documentation for "
                f"{title.lower()} functions."
            ),
            F.lit(""),
            F.lit("## Summary"),
            F.concat(F.lit("- **Python Functions:** "), n_functions),
            F.concat(F.lit("- **SQL Blocks:** "), n_sql),
            F.lit(""),
        ]
        head += [line(folder, 0, i, t, F.lit(True)) for i, t in enumerate(texts)]
        for part, heading, n in ((1, "Python Functions", n_functions), (3, "SQL", n_sql)):
            head.append(line(folder, part, 0, F.lit(f"## {heading}"), n > 0))
            head.append(line(folder, part, 1, F.lit(""), n > 0))
    heads = counts.select(F.inline(F.filter(F.array(*head), lambda r: r.isNotNull())))

    is_sql = F.col("kind") == "sql"
    part = F.when(is_sql, F.lit(4)).otherwise(F.lit(2)).alias("part")
    category = M.category(F.col("classification")).alias("category")
    path = F.col("file_path")
    items = units.select(
        category,
        part,
        "file_path",
        "ordinal",
        F.concat(
            F.lit("- `"), F.col("name"), F.lit("`"),
            F.when(is_sql, F.concat(F.lit(" ("), F.col("sql_type"), F.lit(")"))).otherwise(""),
        ).alias("line"),
    )
    title = F.concat(
        F.lit("### ["), basename(path), F.lit("](./"), M.md_path(path), F.lit(")")
    )
    files = (
        units.select(category, part, "file_path")
        .distinct()
        .select(
            "category",
            "part",
            "file_path",
            F.inline(
                F.array(
                    F.struct(F.lit(_HEADER).alias("ordinal"), title.alias("line")),
                    F.struct(F.lit(_AFTER_ALL).alias("ordinal"), F.lit("").alias("line")),
                )
            ),
        )
    )
    return heads.unionByName(files).unionByName(items)


def overview(units: DataFrame) -> DataFrame:
    """``(category, functions, sql_blocks)`` per category and in total."""
    return (
        units.rollup(M.category(F.col("classification")).alias("category"))
        .agg(_count(None, "function").alias("functions"), _count(None, "sql").alias("sql_blocks"))
        .withColumn("category", F.coalesce("category", F.lit("total")))
    )


def quick_links(units: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` functions of each category as link lines, and a line for the rest.

    ``row_number() <= k`` is cut to ``k`` rows per category in every task before
    the shuffle, so the two categories do not become two big tasks.
    """
    path, name = F.col("file_path"), F.col("name")
    functions = units.filter(F.col("kind") == "function").select(
        M.category(F.col("classification")).alias("category"),
        "file_path",
        "ordinal",
        "name",
        first_line(F.col("description")).alias("summary"),
    )
    order = Window.partitionBy("category").orderBy("file_path", "ordinal")
    first = functions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    links = first.select(
        "category",
        "rank",
        F.concat(
            F.lit("- [`"), name, F.lit("`](./"), F.col("category"), F.lit("/"), M.md_path(path),
            F.lit("#"), F.lower(name), F.lit(") - "), F.col("summary"),
        ).alias("line"),
    )
    more = (
        functions.groupBy("category")
        .agg((F.count("*") - k).alias("rest"))
        .filter(F.col("rest") > 0)
        .select(
            "category",
            F.lit(k + 1).alias("rank"),
            F.concat(F.lit("- ... and "), F.col("rest"), F.lit(" more")).alias("line"),
        )
    )
    return links.unionByName(more)


def overview_page(units: DataFrame, generated: str, k: int = 10) -> DataFrame:
    """Overview document as ``(part, ordinal, line)``; its size does not depend on the corpus."""
    counts = units.agg(
        *[_count(x, kind).alias(f"{kind}_{x}") for x in M.CATEGORIES for kind in ("function", "sql")]
    )

    def row(part: int, at: int, text: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), F.lit(at).alias("ordinal"), text.alias("line")
        )

    def total(kind: str) -> Column:
        return sum((F.col(f"{kind}_{x}") for x in M.CATEGORIES), F.lit(0))

    texts = [
        F.lit("# Business Logic Documentation Index"),
        F.lit(""),
        F.lit("Auto-generated documentation extracted from source code."),
        F.lit(""),
        F.lit(f"**Generated:** {generated}"),
        F.lit(""),
        F.lit("## Overview"),
        F.lit(""),
        F.lit("| Category | Python Functions | SQL Blocks |"),
        F.lit("|----------|------------------|------------|"),
        *[
            F.concat(
                F.lit(f"| [{title}](./{folder}/) | "), F.col(f"function_{x}"),
                F.lit(" | "), F.col(f"sql_{x}"), F.lit(" |"),
            )
            for x, (folder, title) in M.CATEGORIES.items()
        ],
        F.concat(
            F.lit("| **Total** | **"), total("function"), F.lit("** | **"), total("sql"), F.lit("** |")
        ),
        F.lit(""),
        F.lit("## Quick Links"),
        F.lit(""),
    ]
    fixed = [row(0, i, t) for i, t in enumerate(texts)]
    part_of = F.when(F.lit(False), F.lit(0))
    for part, (folder, title) in enumerate(M.CATEGORIES.values(), 1):
        part_of = part_of.when(F.col("category") == folder, F.lit(part))
        fixed += [row(part, -2, F.lit(f"### {title}")), row(part, -1, F.lit(""))]
        fixed += [row(part, _AFTER_ALL, F.lit(""))]
    links = quick_links(units, k).select(
        part_of.alias("part"), F.col("rank").alias("ordinal"), "line"
    )
    return counts.select(F.inline(F.array(*fixed))).unionByName(links)


def page_text(page_rows: DataFrame) -> DataFrame:
    """Whole text per page, for corpora whose pages are known to be small."""
    return page_rows.groupBy("category", "kind", "file_path", "md_path").agg(
        F.concat(
            F.expr("listagg(body, chr(10)) within group (order by chunk)"), F.lit(NL)
        ).alias("text")
    )


def tree_lines(units: DataFrame, repo_url: str | None = None, generated: str = "") -> DataFrame:
    """Every document of the docs tree as ``(path, a, b, c, line)``, sorted by ``(a, b, c)``.

    Paths: ``<category>/<md_path>`` for pages, ``<category>/README.md`` for category indexes and
    ``index.md`` for the overview, so the links these documents hold name files of the tree.
    Two documents on one path keep the one that comes last in the order function page, SQL
    page, category index, overview, then by ``file_path``: a file's SQL page replaces its
    function page, as when the pages are written one after the other. The choice is made on
    one row per document and task before a shuffle, not on the lines; the overview has its
    own path.
    """
    page_rows = pages(units, repo_url).select(
        F.concat("category", F.lit("/"), "md_path").alias("path"),
        F.when(F.col("kind") == "function", 0).otherwise(1).alias("doc"),
        "file_path",
        F.col("chunk").cast("long").alias("a"),
        F.lit("").alias("b"),
        F.lit(0).cast("long").alias("c"),
        F.col("body").alias("line"),
    )
    readmes = category_index(units).select(
        F.concat("category", F.lit("/README.md")).alias("path"),
        F.lit(2).alias("doc"),
        F.lit("").alias("file_path"),
        F.col("part").cast("long").alias("a"),
        F.coalesce("file_path", F.lit("")).alias("b"),
        F.col("ordinal").cast("long").alias("c"),
        "line",
    )
    index = overview_page(units, generated).select(
        F.lit("index.md").alias("path"),
        F.lit(3).alias("doc"),
        F.lit("").alias("file_path"),
        F.col("part").cast("long").alias("a"),
        F.lit("").alias("b"),
        F.col("ordinal").cast("long").alias("c"),
        "line",
    )
    lines = page_rows.unionByName(readmes).unionByName(index)
    category = M.category(F.col("classification")).alias("category")
    kinds = units.select(category, "kind", "file_path").distinct()
    heads = kinds.select(
        F.concat("category", F.lit("/"), M.md_path(F.col("file_path"))).alias("path"),
        F.when(F.col("kind") == "function", 0).otherwise(1).alias("doc"),
        "file_path",
    ).unionByName(
        kinds.select(
            F.concat("category", F.lit("/README.md")).alias("path"), F.lit(2).alias("doc"),
            F.lit("").alias("file_path"),
        ).distinct()
    ).unionByName(
        units.sparkSession.createDataFrame([("index.md", 3, "")], "path string, doc int, file_path string")
    )
    winners = heads.groupBy("path").agg(F.max(F.struct("doc", "file_path")).alias("w"))
    chosen = winners.select("path", F.col("w.doc").alias("doc"), F.col("w.file_path").alias("file_path"))
    return lines.join(chosen, ["path", "doc", "file_path"], "left_semi").select(
        "path", "a", "b", "c", "line"
    )
