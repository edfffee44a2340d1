"""Whitening of embeddings by the principal directions of their covariance.

Method: bidiagonal qd solver.
1. Blockwise QR (TSQR): every task reduces its centred rows, a block at a time, to one upper
   triangular ``R`` of ``d x d``; the ``R`` of all tasks are stacked and reduced again in groups
   of ``FAN`` until few are left. ``R^T R`` is then the scatter matrix of the centred rows, and
   no task or driver ever holds more than ``FAN`` such matrices.
2. Householder bidiagonalisation of the final ``R`` into ``B`` (diagonal ``a``, super-diagonal
   ``b``), keeping the right reflectors ``P``: ``R^T R = P B^T B P^T``.
3. dqds (shifted differential quotient-difference) finds all squared singular values of ``B``
   to high relative accuracy.
4. For each wanted value a twisted factorisation of ``B^T B - s`` (stationary from the top,
   progressive from the bottom, twisted where ``|gamma|`` is least) gives its vector, which ``P``
   turns into a direction of the embeddings.

Every pass over the rows is a Spark job: the distinct list is a shuffle with map-side
combining (a vector held by a third of all rows is one row per task before the shuffle),
sums and the test of the result are aggregations, the projection is a native expression of
literals (``k x d`` numbers), and nothing that grows with the rows reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import col
from .tables import Workspace

COMPONENTS = 4
BLOCK = 4096
FAN = 16
SCALE = 256
_EPS = np.finfo(float).eps
OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


# -- the matrix part: small, d x d, on the driver ---------------------------------------


def house(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Reflector ``I - beta v v^T`` that maps ``x`` to ``alpha e1``."""
    norm = float(np.linalg.norm(x))
    v = x.astype(float).copy()
    if norm == 0.0:
        return v, 0.0, 0.0
    alpha = -math.copysign(norm, x[0])
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, P) with ``r = U B P^T``, ``B`` upper bidiagonal of diagonal a and super-diagonal b."""
    m = r.astype(float).copy()
    d = m.shape[1]
    p = np.eye(d)
    for k in range(d):
        v, beta, _ = house(m[k:, k])
        if beta:
            m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
        if k < d - 2:
            v, beta, _ = house(m[k, k + 1 :])
            if beta:
                m[k:, k + 1 :] -= beta * np.outer(m[k:, k + 1 :] @ v, v)
                p[:, k + 1 :] -= beta * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), p


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared singular values of the bidiagonal (a, b), largest first.

    Shifted dqds sweeps keep ``q = a^2, e = b^2`` positive; a shift that makes a pivot
    negative is refused and a smaller one tried, shift 0 always holds. The bottom value
    deflates once its ``e`` is below ``eps^2`` of it.
    """
    q = np.asarray(a, float) ** 2
    e = np.asarray(b, float) ** 2
    found: list[float] = []
    total = 0.0
    m = len(q)
    factor, least = 0.5, None
    while m > 0:
        if m == 1:
            found.append(total + q[0])
            break
        if e[m - 2] <= _EPS * _EPS * (total + q[m - 1]) or e[m - 2] == 0.0:
            found.append(total + q[m - 1])
            m -= 1
            factor, least = 0.5, None
            continue
        shift = factor * least if least else 0.0
        swept = _sweep(q[:m], e[: m - 1], shift)
        if swept is None:
            factor = factor * 0.25 if factor > 1e-6 else 0.0
            continue
        q[:m], e[: m - 1], least = swept
        total += shift
        factor = min(0.999, 1 - (1 - factor) * 0.5)
    return np.sort(np.maximum(np.asarray(found), 0.0))[::-1]


def _sweep(q: np.ndarray, e: np.ndarray, shift: float):
    """One dqds sweep with ``shift``; None if a pivot turns negative."""
    m = len(q)
    qh, eh = np.empty(m), np.empty(m - 1)
    d = q[0] - shift
    least = d
    for i in range(m - 1):
        if d < 0:
            return None
        qh[i] = d + e[i]
        if qh[i] == 0.0:  # a split with a zero value above it
            eh[i] = 0.0
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / qh[i]
            eh[i] = e[i] * t
            d = d * t - shift
        least = min(least, d)
    if d < 0:
        return None
    qh[m - 1] = d
    return qh, eh, max(least, 0.0)


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of ``B^T B`` for ``value`` by the twisted factorisation of ``B^T B - value``."""
    m = len(a)
    t = a**2 + np.concatenate([[0.0], b**2]) - value  # diagonal of B^T B - value
    o = a[:-1] * b  # its off-diagonal
    tiny = np.finfo(float).tiny
    top, low = np.empty(m), np.empty(m)  # pivots from the top and from the bottom
    ell, you = np.empty(max(m - 1, 0)), np.empty(max(m - 1, 0))
    top[0] = t[0]
    for i in range(m - 1):
        pivot = top[i] if top[i] != 0.0 else tiny
        ell[i] = o[i] / pivot
        top[i + 1] = t[i + 1] - ell[i] * o[i]
    low[m - 1] = t[m - 1]
    for i in range(m - 2, -1, -1):
        pivot = low[i + 1] if low[i + 1] != 0.0 else tiny
        you[i] = o[i] / pivot
        low[i] = t[i] - you[i] * o[i]
    gamma = top + low - t
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(m)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -ell[i] * z[i + 1]
    for i in range(k, m - 1):
        z[i + 1] = -you[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, rows: int, count: int = COMPONENTS):
    """(eigenvalues of the covariance ``R^T R / rows``, all, largest first; unit vectors of the
    first ``count`` of them that are above rounding, as rows)."""
    a, b, p = bidiagonalise(r)
    squares = dqds(a, b)
    values = squares / rows
    keep = [s for s in squares[:count] if s > len(a) * _EPS * squares[0]]
    vectors = []
    for s in keep:
        v = p @ twisted_vector(a, b, s)
        for w in vectors:  # guard against lost orthogonality in close clusters
            v -= (w @ v) * w
        v /= np.linalg.norm(v)
        big = int(np.argmax(np.abs(v)))
        vectors.append(v if v[big] > 0 else -v)
    return values, np.array(vectors).reshape(len(vectors), len(a))


# -- the Spark part ----------------------------------------------------------------------


def integer_vectors(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of rows whose vector is whole and finite, and the dimension.

    ``x`` is ``floor(256 * c)`` of every entry as long. Rows whose vector is null, holds a null,
    NaN or an infinity, or is shorter or longer than the longest such vector are left out.
    """
    finite = F.forall(
        col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    valid = embeddings.select(col("vec_id").cast("long").alias("vec_id"), col(vector).alias("v"))
    valid = valid.where(F.col("v").isNotNull() & finite)
    dimension = valid.agg(F.max(F.size("v"))).first()[0]
    if dimension is None:
        return valid.select("vec_id", F.array().cast("array<long>").alias("x")), 0
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return valid.where(F.size("v") == dimension).select("vec_id", x.alias("x")), dimension


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int], float]:
    """n, per-dimension sums, trace of the covariance; exact integers, one aggregation."""
    entries = fit.select(F.posexplode("x").alias("j", "x"))
    per = entries.groupBy("j").agg(
        F.count("*").alias("n"),
        F.sum(F.col("x").cast("decimal(38,0)")).alias("s"),
        F.sum(F.col("x").cast("decimal(38,0)") * F.col("x")).alias("q"),
    )
    got = {r.j: r for r in per.collect()}  # one row per dimension
    if not got:
        return 0, [0] * dimension, 0.0
    n = int(got[0].n)
    sums = [int(got[j].s) for j in range(dimension)]
    scatter = sum(n * int(got[j].q) - int(got[j].s) ** 2 for j in range(dimension))
    return n, sums, scatter / n / n


def _block_r(fit: DataFrame, mean: np.ndarray, dimension: int) -> DataFrame:
    """One ``R`` per task of its centred rows, reduced a block of ``BLOCK`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held = None, []

        def fold(r, held):
            block = np.array(held, dtype=float) - mean
            stacked = block if r is None else np.vstack([r, block])
            return np.linalg.qr(stacked, mode="r")

        for batch in batches:
            for values in batch.column(0).to_pylist():
                held.append(values)
                if len(held) >= BLOCK:
                    r, held = fold(r, held), []
        if held:
            r = fold(r, held)
        if r is not None:
            task = TaskContext.get()
            yield pa.RecordBatch.from_pydict(
                {"part": [task.partitionId() if task else 0], "r": [_square(r, dimension).ravel().tolist()]}
            )

    return fit.select("x").mapInArrow(run, "part long, r array<double>")


def _square(r: np.ndarray, dimension: int) -> np.ndarray:
    """``r`` as ``d x d`` (a block of fewer rows than ``d`` gives a flat ``R``)."""
    out = np.zeros((dimension, dimension))
    out[: r.shape[0]] = r[:dimension]
    return out


def _reduce(parts: DataFrame, dimension: int, work: Workspace) -> np.ndarray:
    """Stack and reduce the ``R`` of the tasks in groups of ``FAN`` until ``FAN`` are left.

    Each level is written to the shared folder, so a lost executor costs one level at most.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.asarray(v).reshape(dimension, dimension) for v in frame["r"]])
        r = _square(np.linalg.qr(stacked, mode="r"), dimension)
        return pd.DataFrame({"part": [int(frame["g"].iloc[0])], "r": [r.ravel().tolist()]})

    parts = work.keep(parts, "r0")
    level = 0
    while parts.count() > FAN:
        level += 1
        grouped = parts.withColumn("g", F.floor(F.col("part") / FAN)).groupBy("g")
        parts = work.keep(grouped.applyInPandas(merge, "part long, r array<double>"), f"r{level}")
    stacked = [np.asarray(r.r).reshape(dimension, dimension) for r in parts.collect()]
    return _square(np.linalg.qr(np.vstack(stacked), mode="r"), dimension)


def _projection(x, mean: np.ndarray, vector: np.ndarray, value: float):
    centred = F.zip_with(x, F.array(*[F.lit(float(m)) for m in mean]), lambda a, m: a - m)
    terms = F.zip_with(centred, F.array(*[F.lit(float(v)) for v in vector]), lambda c, v: c * v)
    return F.aggregate(terms, F.lit(0.0), lambda acc, y: acc + y) / F.lit(math.sqrt(value))


def whiten(embeddings: DataFrame, count: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """``OUT`` for every kept row and each of the first ``count`` components.

    Kept rows are those of ``integer_vectors``; repeated rows all come out, but the fit list
    holds each distinct ``x`` once (``n`` of them, sums ``S``). The covariance is over the fit
    list with divisor ``n``; components are its unit eigenvectors by falling eigenvalue ``e``,
    signed so that their largest entry is positive. ``whitened`` is ``(x - S/n) . v / sqrt(e)``,
    ``explained`` ``e / trace``, ``deviation`` the exact ``sum (n x - S)^2`` and
    ``identity_error`` the largest entry of the whitened fit list's covariance minus the
    identity. Components whose eigenvalue is zero up to rounding (fewer distinct vectors than
    dimensions) are left out. A null ``vec_id`` stays null; other columns are not returned, so
    their names do not matter; an empty table, or one with no whole vector, gives no rows.
    """
    spark: SparkSession = embeddings.sparkSession
    rows, dimension = integer_vectors(embeddings, vector)
    schema = OUT
    if dimension == 0:
        return spark.createDataFrame([], schema)
    work = Workspace(spark, "whitening")
    fit = work.keep(rows.select("x").distinct(), "fit")
    n, sums, trace = _sums(fit, dimension)
    if n == 0:
        return spark.createDataFrame([], schema)
    mean = np.array(sums, dtype=float) / n
    r = _reduce(_block_r(fit, mean, dimension), dimension, work)
    values, vectors = directions(r, n, count)
    picked = list(range(len(vectors)))
    if not picked:
        return spark.createDataFrame([], schema)
    w = [_projection(F.col("x"), mean, vectors[k], values[k]).alias(f"w{k}") for k in picked]
    test = fit.select(*w)
    moments = [F.sum(F.col(f"w{a}") * F.col(f"w{b}")) for a in picked for b in picked]
    firsts = [F.sum(f"w{a}") for a in picked]
    got = test.agg(*moments, *firsts).first()
    k = len(picked)
    second = np.array(got[: k * k], dtype=float).reshape(k, k) / n
    first = np.array(got[k * k :], dtype=float) / n
    identity_error = float(np.max(np.abs(second - np.outer(first, first) - np.eye(k))))
    exact = F.aggregate(
        F.zip_with(
            F.col("x"),
            F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums]),
            lambda a, s: a.cast("decimal(38,0)") * F.lit(n).cast("decimal(38,0)") - s,
        ),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, y: (acc + y * y).cast("decimal(38,0)"),
    )
    parts = F.array(
        *[
            F.struct(
                F.lit(c + 1).alias("component"),
                F.col(f"w{c}").alias("whitened"),
                F.lit(float(values[c] / trace) if trace else float("nan")).alias("explained"),
            )
            for c in picked
        ]
    )
    out = rows.select("vec_id", "x", *w).select(
        "vec_id", exact.cast("long").alias("deviation"), F.explode(parts).alias("c")
    )
    return out.select(
        "vec_id",
        F.col("c.component").cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(identity_error).alias("identity_error"),
    )
