"""The union of all code units of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .py_units import functions_of, parse_functions
from .sql_units import IS_PY, all_sql


def as_units(found_functions: DataFrame | None, found_sql: DataFrame | None) -> DataFrame:
    """Functions and SQL blocks under one schema; ``kind`` tells them apart."""
    parts = []
    if found_functions is not None:
        parts.append(
            found_functions.withColumnRenamed("docstring", "description").withColumn(
                "kind", F.lit("function")
            )
        )
    if found_sql is not None:
        parts.append(found_sql.withColumn("kind", F.lit("sql")))
    if len(parts) == 1:
        return parts[0]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def python_files(files: DataFrame) -> DataFrame:
    """Readable Python files of a table of files."""
    wanted = files.filter(F.col("file_path").like(IS_PY) & F.col("content").isNotNull())
    return wanted.drop("error")


def extract_units(
    files: DataFrame, dollar_quotes: bool = True, parsed: DataFrame | None = None
) -> DataFrame:
    """Every function and SQL block of a table of source files.

    ``parsed`` is the result of ``parse_functions`` over the same files, if that is
    kept in a table already.
    """
    if parsed is None:
        parsed = parse_functions(python_files(files))
    readable = files.filter(F.col("content").isNotNull()).drop("error")
    return as_units(functions_of(parsed), all_sql(readable, dollar_quotes))


def file_errors(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """``(file_path, step, error)`` of files that could not be read or parsed as a whole."""
    steps = [("read", files), ("parse", parsed)] if "error" in files.columns else [("parse", parsed)]
    found = [
        df.filter(F.col("error").isNotNull()).select("file_path", F.lit(step).alias("step"), "error")
        for step, df in steps
    ]
    return reduce(DataFrame.unionByName, found)
