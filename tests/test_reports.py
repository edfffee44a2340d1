"""Pages, indexes and overview."""

import pytest
from pyspark.sql import functions as F

from corpusrules.operators import reports as R
from corpusrules.operators.classify import classify
from corpusrules.operators.units import extract_units
from corpusrules.sources import documents as D


@pytest.fixture(scope="module")
def units(files):
    texts = {
        "src/a.py": (
            '@deco\ndef load_x(a: int, b=2) -> str:\n    """Load it.\n\n    More.\n    """\n'
            "    # BUSINESS_RULE: never twice\n    return a\n\n\ndef load_y(): pass\n"
            'spark.sql("SELECT policy FROM t")\n'
        ),
        "src/b.sql": "-- Totals\nSELECT kpi FROM s.t;\nSELECT 1;\n",
    }
    return classify(extract_units(files(texts))).cache()


def text_of(pages, **where):
    rows = R.page_text(pages).filter(" and ".join(f"{k} = '{v}'" for k, v in where.items()))
    (row,) = rows.collect()
    return row.text


def test_function_page(units):
    text = text_of(R.function_pages(units, "https://h/r"), category="business-logic")
    assert text == (
        "# a.py\n\n**File:** `src/a.py`\n\n---\n\n## load_x\n\n"
        "[View Source](https://h/r/blob/main/src/a.py#L2-L8)\n\n"
        "### Signature\n```python\ndef load_x(a: int, b = 2) -> str\n```\n\n"
        "### Description\nLoad it.\n\n    More.\n\n"
        "### Business Rules\n- never twice\n\n"
        "### Parameters\n| Name | Type | Default |\n|------|------|---------|\n"
        "| `a` | int | - |\n| `b` | - | 2 |\n\n"
        "### Returns\n- `str`\n\n### Decorators\n- `@deco`\n\n"
        "*Classification: business_logic (high confidence)*\n"
        "*Reason: Contains BUSINESS_RULE markers: never twice*\n\n---\n"
    )


def test_function_page_without_optional_parts(units):
    text = text_of(R.function_pages(units), category="pipeline-code")
    assert text == (
        "# a.py\n\n**File:** `src/a.py`\n\n---\n\n## load_y\n\n"
        "### Signature\n```python\ndef load_y()\n```\n\n"
        "*Classification: pipeline_code (medium confidence)*\n"
        "*Reason: Matches 1 pipeline code patterns*\n\n---\n"
    )


def test_sql_page(units):
    text = text_of(R.sql_pages(units), category="business-logic", md_path="src-b.md")
    assert text == (
        "# b.sql\n\n**File:** `src/b.sql`\n\n---\n\n## unnamed_query\n\n**Type:** query\n\n"
        "### Description\nTotals\n\n### Tables Referenced\n- `s.t`\n\n"
        "### Source\n```sql\n-- Totals\nSELECT kpi FROM s.t;\n```\n\n"
        "*Classification: business_logic (medium confidence)*\n\n---\n"
    )


def test_pages_of_both_kinds_are_kept(units):
    rows = R.pages(units).filter("category = 'business-logic' and md_path = 'src-a.md'")
    assert {r.kind for r in rows.collect()} == {"function", "sql"}


def test_long_page_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "UNITS_PER_CHUNK", 10)
    units = spark.range(35).select(
        F.lit("sql").alias("kind"), F.lit("x.sql").alias("file_path"),
        F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("q"), F.col("id")).alias("name"),
        F.lit("query").alias("sql_type"), F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("markers"), F.array().cast("array<string>").alias("tables"),
        F.lit("S").alias("source_code"), F.lit("pipeline_code").alias("classification"),
        F.lit("low").alias("confidence"), F.lit("r").alias("reason"),
    )
    pages = R.sql_pages(units)
    assert sorted(r.chunk for r in pages.collect()) == [-1, 0, 1, 2, 3]
    text = R.page_text(pages).first().text
    names = [line[3:] for line in text.split("\n") if line.startswith("## ")]
    assert names == [f"q{i}" for i in range(35)]
    assert "\n\n\n" not in text


def test_category_index(units):
    lines = R.category_index(units).orderBy(*R.INDEX_ORDER).collect()
    business = "\n".join(r.line for r in lines if r.category == "business-logic")
    assert business == (
        "# Business Logic Documentation\n\n"
        "This directory contains auto-generated documentation for business logic functions.\n\n"
        "## Summary\n- **Python Functions:** 1\n- **SQL Blocks:** 2\n\n"
        "## Python Functions\n\n### [a.py](./src-a.md)\n- `load_x`\n\n"
        "## SQL\n\n### [a.py](./src-a.md)\n- `embedded_sql_1` (query)\n\n"
        "### [b.sql](./src-b.md)\n- `unnamed_query` (query)\n"
    )


def test_index_of_an_empty_category(units):
    lines = R.category_index(units.filter("classification = 'business_logic'"))
    rows = lines.filter("category = 'pipeline-code'").orderBy(*R.INDEX_ORDER).collect()
    assert [r.line for r in rows][-3:] == ["- **Python Functions:** 0", "- **SQL Blocks:** 0", ""]


def test_overview(units):
    rows = {r.category: (r.functions, r.sql_blocks) for r in R.overview(units).collect()}
    assert rows == {"business-logic": (1, 2), "pipeline-code": (1, 1), "total": (2, 3)}


def test_quick_links(spark):
    df = spark.range(12).select(
        F.lit("function").alias("kind"),
        F.lit("business_logic").alias("classification"),
        F.concat(F.lit("d/f"), (F.col("id") % 2), F.lit(".py")).alias("file_path"),
        F.col("id").cast("int").alias("ordinal"),
        F.concat(F.lit("Fn"), F.col("id")).alias("name"),
        F.when(F.col("id") == 0, F.lit("First.\nSecond.")).alias("description"),
    )
    rows = R.quick_links(df).orderBy("rank").collect()
    assert len(rows) == 11
    assert rows[0].line == "- [`Fn0`](./business-logic/d-f0.md#fn0) - First."
    assert rows[6].line == "- [`Fn1`](./business-logic/d-f1.md#fn1) - No description"
    assert rows[10].line == "- ... and 2 more"
    assert R.quick_links(df, 12).filter("line like '%more'").count() == 0
    # two categories: each task hands on k rows per category, not its whole share
    label = F.when(F.col("ordinal") > 5, F.lit("business_logic")).otherwise(F.lit("pipeline_code"))
    two = df.withColumn("classification", label)
    plan = R.quick_links(two)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_overview_page(units):
    rows = R.overview_page(units, "now").orderBy("part", "ordinal").collect()
    text = "\n".join(r.line for r in rows)
    assert text == (
        "# Business Logic Documentation Index\n\n"
        "Auto-generated documentation extracted from source code.\n\n**Generated:** now\n\n"
        "## Overview\n\n| Category | Python Functions | SQL Blocks |\n"
        "|----------|------------------|------------|\n"
        "| [Business Logic](./business-logic/) | 1 | 2 |\n| [Pipeline Code](./pipeline-code/) | 1 | 1 |\n"
        "| **Total** | **2** | **3** |\n\n## Quick Links\n\n### Business Logic\n\n"
        "- [`load_x`](./business-logic/src-a.md#load_x) - Load it.\n\n### Pipeline Code\n\n"
        "- [`load_y`](./pipeline-code/src-a.md#load_y) - No description\n"
    )


def read_parts(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_written_pages_and_index(units, tmp_path):
    pages = R.pages(units)
    D.write_pages(pages, str(tmp_path / "pages"))
    written = read_parts(tmp_path / "pages" / "category=business-logic" / "md_path=src-b.md")
    assert written == text_of(pages, category="business-logic", md_path="src-b.md")

    D.write_index(R.category_index(units), str(tmp_path / "index"))
    index = read_parts(tmp_path / "index" / "category=pipeline-code")
    assert index.startswith("# Pipeline Code Documentation\n\n") and "- `load_y`\n" in index

    D.write_lines(R.overview_page(units, "now"), ("part", "ordinal"), str(tmp_path / "overview"))
    assert read_parts(tmp_path / "overview").startswith("# Business Logic Documentation Index\n\n")

    D.write_page_table(pages, str(tmp_path / "table"))
    assert pages.sparkSession.read.parquet(str(tmp_path / "table")).count() == pages.count()
