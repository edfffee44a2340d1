"""Whitening against numpy's symmetric eigen solver on the same integer vectors."""

import math

import numpy as np
import pytest

from corpusrules.llm import whitening

RNG = np.random.default_rng(12)


def brute(rows, count=4):
    kept = [
        (i, np.floor(256 * np.asarray(v, dtype=np.float32).astype(float)).astype(np.int64))
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    size = max((len(x) for _, x in kept), default=0)
    kept = [(i, x) for i, x in kept if len(x) == size]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=float)
    n = len(fit)
    mean = fit.sum(0) / n
    cov = (fit - mean).T @ (fit - mean) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:count]
    sums = fit.sum(0).astype(np.int64)
    out = {}
    for i, x in kept:
        for c, k in enumerate(order):
            w = (x - mean) @ vectors[:, k] / math.sqrt(values[k])
            dev = int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)))
            out.setdefault((i, c + 1), []).append((n, dev, abs(w), values[k] / np.trace(cov)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    base = RNG.normal(size=(300, 16)) * np.linspace(0.05, 0.6, 16)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)]  # a hot repeated vector
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 14), (2002, [float("nan")] * 16)]
    rows += [(2003, [float("inf")] + [0.0] * 15), (2004, [0.5] * 3), (2005, rows[3][1])]
    frame = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, `whitened` string"
    )
    return frame.repartition(4), rows


def test_against_eigh(spark, table):
    frame, rows = table
    got = whitening.whiten(frame).collect()
    want = brute(rows)
    assert len(got) == sum(len(v) for v in want.values())
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() <= 1e-9
    signs = {}
    for r in got:
        n, dev, w, explained = want[(r.vec_id, r.component)][0]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(abs(r.whitened) - w) <= 1e-9 * max(1.0, w)
        assert abs(r.explained - explained) <= 1e-12
    same = {(r.vec_id, r.component): r.whitened for r in got}
    for c in range(1, 5):  # copies of row 7 and of row 3 whiten alike, under one sign
        assert all(same[(1000 + i, c)] == same[(7, c)] for i in range(50))
        assert same[(2005, c)] == same[(3, c)]
    assert {r.vec_id for r in got} == set(range(300)) | set(range(1000, 1050)) | {2005}


def test_rank_deficient_and_edges(spark):
    rows = [(1, [0.25, 0.5, 0.75]), (2, [0.5, 1.0, 1.5]), (3, [0.75, 1.5, 2.25]), (4, [0.25, 0.5, 0.75])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    assert {r.component for r in got} == {1} and len(got) == 4
    assert got[0].n == 3 and abs(got[0].explained - 1) < 1e-12
    empty = frame.where("vec_id < 0")
    assert whitening.whiten(empty).collect() == []
    nulls = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert whitening.whiten(nulls).collect() == []


def test_dqds_and_twisted_vectors():
    for d, n in [(64, 400), (9, 9), (3, 50)]:
        x = RNG.normal(size=(n, d)) * RNG.uniform(0.01, 5, size=d)
        r = whitening._square(np.linalg.qr(x, mode="r"), d)
        a, b, p = whitening.bidiagonalise(r)
        bd = np.diag(a) + np.diag(b, 1)
        assert np.allclose(p @ bd.T @ bd @ p.T, r.T @ r, rtol=0, atol=1e-9 * np.abs(r.T @ r).max())
        squares = whitening.dqds(a, b)
        want = np.sort(np.linalg.eigvalsh(r.T @ r))[::-1]
        assert np.max(np.abs(squares - want)) <= 1e-12 * want[0]
        values, vectors = whitening.directions(r, n)
        cov = r.T @ r / n
        for v, e in zip(vectors, values):
            assert np.linalg.norm(cov @ v - e * v) <= 1e-10 * values[0]
