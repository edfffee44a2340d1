"""SQL statements of ``.sql`` files and SQL strings inside ``.py`` files, one row each.

Input of every operator: a DataFrame with ``file_path`` and ``content``; further
columns (such as ``commit``) are carried through. There is no shuffle: a file is
one row, and its statements are generated from that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sql_text as S

IS_SQL = "%.sql"
IS_PY = "%.py"


def carried(files: DataFrame) -> list[str]:
    """Columns of a table of files that go along with every unit, such as ``commit``."""
    return [c for c in files.columns if c not in ("file_path", "content", "error")]


def _generate(files: DataFrame, found: Column, *more: Column) -> DataFrame:
    """One row per element, ``ordinal`` being its position in the file."""
    return files.select(
        "file_path", *carried(files), *more, F.posexplode(found).alias("ordinal", "found")
    ).select("*", "found.text", "found.start_line").drop("found")


def split_statements(files: DataFrame, dollar_quotes: bool = True) -> DataFrame:
    """``(file_path, ordinal, text, start_line)`` per statement of a SQL file.

    With ``dollar_quotes`` a statement does not end inside a ``$$`` body.
    """
    return _generate(files, S.statement_array(F.col("content"), dollar_quotes))


def _blocks(statements: DataFrame, name: Column | None = None) -> DataFrame:
    text = F.col("text")
    typed = statements.withColumn("sql_type", S.sql_type(text))
    named = S.sql_name(text, F.col("sql_type"))
    own = ("file_path", "ordinal", "text", "start_line", "embedded")
    return typed.select(
        "file_path",
        *[c for c in statements.columns if c not in own],
        "ordinal",
        (named if name is None else F.coalesce(name, named)).alias("name"),
        "start_line",
        (F.col("start_line") + F.size(S.lines_of(text)) - 1).alias("end_line"),
        "sql_type",
        S.sql_description(text).alias("description"),
        S.sql_markers(text).alias("markers"),
        text.alias("source_code"),
        S.sql_tables(text).alias("tables"),
        S.sql_columns(text).alias("columns"),
    )


def sql_blocks(files: DataFrame, dollar_quotes: bool = True) -> DataFrame:
    """All parts of the statements of SQL files."""
    return _blocks(split_statements(files, dollar_quotes))


def _embedded_name() -> Column:
    return F.concat(F.lit("embedded_sql_"), F.col("ordinal") + 1)


def embedded_sql(py_files: DataFrame) -> DataFrame:
    """All parts of the SQL strings passed to SQL calls in Python files."""
    found = _generate(py_files, S.embedded_array(F.col("content")))
    return _blocks(found, _embedded_name())


def all_sql(files: DataFrame, dollar_quotes: bool = True) -> DataFrame:
    """Blocks of both kinds from a table of mixed files, in one pass over it."""
    path, content = F.col("file_path"), F.col("content")
    embedded = path.like(IS_PY)
    found = F.when(embedded, S.embedded_array(content)).otherwise(
        S.statement_array(content, dollar_quotes)
    )
    wanted = files.filter(path.like(IS_SQL) | path.like(IS_PY))
    rows = _generate(wanted, found, embedded.alias("embedded"))
    return _blocks(rows, F.when(F.col("embedded"), _embedded_name()))
