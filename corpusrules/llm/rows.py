"""Row-wise Arrow helpers: a small Python function per text, Spark deals out the rows."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROWS_OUT = 2000


#: What a Python worker holds from task to task, as caches of one entry.
_HELD: list = []


def col(name: str):
    return F.col(f"`{name}`")


def worker_held(make: Callable) -> Callable:
    """``make`` with its last result held in the Python worker for later tasks, until ``let_go``."""
    cached = lru_cache(maxsize=1)(make)
    _HELD.append(cached)
    return cached


def let_go() -> None:
    """Drop what earlier tasks of this Python worker hold: a worker outlives its query, and
    tables of one operator would count against the memory of the next."""
    if any(cached.cache_info().currsize for cached in _HELD):
        for cached in _HELD:
            cached.cache_clear()
        gc.collect()


def add_columns(
    df: DataFrame, inputs: str | list[str], schema: str, make: Callable[[], Callable[..., tuple]]
) -> DataFrame:
    """``df`` with the columns of ``schema``, made from the ``inputs`` by ``make()``.

    ``make`` is called once per task and returns a function of the inputs of one row, the first
    of them a text. Rows keep their number and their other columns; a column of ``df``
    named like one of ``schema`` is replaced. Nothing is shuffled, one batch is held at a time.
    """
    inputs = [inputs] if isinstance(inputs, str) else inputs
    added = T.StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    read = [col(inputs[0]).cast("string"), *map(col, inputs[1:])]
    # positional names inside, so that no name of the caller (dots, clashes) is parsed
    source = df.select(
        *[col(f.name).alias(f"__kept{i}") for i, f in enumerate(kept)],
        *[c.alias(f"__in{i}") for i, c in enumerate(read)],
    )
    names = [*(f"__kept{i}" for i in range(len(kept))), *added.names]
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                given = zip(*part.columns[len(kept) :], strict=True)
                rows = [function(*[x.as_py() for x in row]) for row in given]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    part.columns[: len(kept)]
                    + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=names,
                )

    inner = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, [*kept, *added.fields])]
    out = source.mapInArrow(run, T.StructType(inner))
    return out.toDF(*[f.name for f in kept], *added.names)


def batches_of(rows: Iterable[tuple], names: list[str], kinds: list, size: int = 20000):
    """Record batches of at most ``size`` tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, names, kinds)
            held = []
    if held:
        yield _batch(held, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores is dealt out round robin."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
