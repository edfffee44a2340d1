"""Functions of Python files, one row each.

One parse per file runs on the executors and returns source text cuts; every
derived column (signature, docstring text, rule markers) is native.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import py_text as P
from ..functions.py_syntax import function_facts, salvaged_facts
from .sql_units import carried

PARAMETERS = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("default", T.StringType()),
        ]
    )
)
_FACTS = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("parameters", PARAMETERS),
        T.StructField("return_type", T.StringType()),
        T.StructField("doc_literal", T.StringType()),
        T.StructField("doc_offset", T.IntegerType()),
        T.StructField("decorators", T.ArrayType(T.StringType())),
        T.StructField("source_code", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
# rows per result batch: bounds the memory of one Python worker, drops nothing
_BATCH_ROWS = 2000


def parse_functions(py_files: DataFrame) -> DataFrame:
    """Raw facts per function, plus one row with ``error`` per file with errors.

    A file that does not parse as a whole still gives the functions that can be read.
    """
    keys = py_files.select("file_path", *carried(py_files))
    schema = T.StructType(keys.schema.fields + _FACTS.fields)
    arrow_schema = to_arrow_schema(schema)
    key_names = keys.columns

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for row in range(batch.num_rows):
                key = {k: batch.column(k)[row].as_py() for k in key_names}
                content = batch.column("content")[row].as_py()
                try:
                    facts = function_facts(content or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    facts = salvaged_facts(content)
                    out.append(key | {"error": f"{type(e).__name__}: {e}"})
                out.extend(key | f | {"ordinal": i} for i, f in enumerate(facts))
                if len(out) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return py_files.select(*key_names, "content").mapInArrow(parse, schema)


def functions(py_files: DataFrame) -> DataFrame:
    """All parts of the functions of Python files."""
    return functions_of(parse_functions(py_files))


def functions_of(parsed: DataFrame) -> DataFrame:
    keep = [c for c in parsed.columns if c not in _FACTS.names]
    cut = parsed.filter(F.col("error").isNull()).select(
        *keep,
        "ordinal",
        "name",
        "start_line",
        "end_line",
        P.without_receivers(F.col("parameters")).alias("parameters"),
        "return_type",
        P.docstring(F.col("doc_literal")).alias("docstring"),
        "doc_literal",
        "doc_offset",
        F.transform("decorators", lambda d: F.concat(F.lit("@"), d)).alias("decorators"),
        "source_code",
    )
    return cut.select(
        *keep,
        "ordinal",
        "name",
        "start_line",
        "end_line",
        P.py_signature(F.col("name"), F.col("parameters"), F.col("return_type")).alias("signature"),
        "parameters",
        "return_type",
        "docstring",
        P.py_markers(
            F.col("source_code"), F.col("docstring"), F.col("doc_literal"), F.col("doc_offset")
        ).alias("markers"),
        "source_code",
        "decorators",
    )


def parse_errors(py_files: DataFrame) -> DataFrame:
    """``(file_path, error)`` of the files that do not parse as a whole."""
    return parse_functions(py_files).filter(F.col("error").isNotNull()).select("file_path", "error")
