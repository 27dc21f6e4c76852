"""Whitening against numpy's eigenvectors: the solver alone, on a given table, on awkward rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from resalio.llm import whitening

VECTORS = "vec_id long, embedding array<double>"


def reference(rows):
    """Rows that stay, by id and x, and the mean, eigenvalues and eigenvectors of the distinct x, by numpy."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in kept], float)) + 0
    u = np.unique(x, axis=0)
    y = u - u.sum(0) / len(u)
    values, vectors = np.linalg.eigh(y.T @ y / len(u))
    return [i for i, _ in kept], x, u, values[::-1], vectors[:, ::-1]


def same(got, rows, components=4, close=1e-9):
    ids, x, u, values, vectors = reference(rows)
    n, s = len(u), u.sum(0)
    assert len(got) == components * len(ids)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    key = lambda i: (i is None, i)
    deviations = sorted((key(i), int(d)) for i, d in zip(ids, np.square(n * x - s).sum(1)))
    for k in range(components):
        mine = [r for r in got if r.component == k + 1]
        assert sorted((key(r.vec_id), r.deviation) for r in mine) == deviations
        assert {r.explained for r in mine} == {mine[0].explained} and abs(mine[0].explained * values.sum() / values[k] - 1) < 1e-12
        want = (x - s / n) @ vectors[:, k] / math.sqrt(values[k])
        a = sorted((key(r.vec_id), r.whitened) for r in mine)
        b, c = (sorted((key(i), w) for i, w in zip(ids, sign * want)) for sign in (1, -1))
        assert min(max(abs(p[1] - q[1]) for p, q in zip(a, o)) for o in (b, c)) < close


@pytest.mark.parametrize("size, wanted", [(64, 4), (200, 4), (5, 4), (3, 3), (1, 1), (40, 7)])
def test_solver_equals_numpy(size, wanted):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, 3 * size))
    v = a @ a.T / size
    values, vectors = whitening.jacobi_davidson(lambda b: v @ b, size, wanted, np.trace(v))
    want, basis = np.linalg.eigh(v)
    assert np.abs(values - want[::-1][:wanted]).max() < 1e-13 * want.max()
    assert np.abs(np.abs((basis[:, ::-1][:, :wanted] * vectors).sum(0)) - 1).max() < 1e-12
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-12 * want.max()


@pytest.mark.parametrize("spectrum", [np.ones(40), np.r_[np.full(6, 5.0), np.ones(34)], np.r_[1e6, 1e3, 1, 1e-3, np.zeros(36)], np.r_[2, np.zeros(39)], 1 + 1e-5 * np.arange(40)])
def test_solver_on_repeated_and_zero_values(spectrum):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((40, 40)))[0]
    v = (q * spectrum) @ q.T
    values, vectors = whitening.jacobi_davidson(lambda b: v @ b, 40, 4, spectrum.sum())
    assert np.abs(values - np.sort(spectrum)[::-1][:4]).max() < 1e-12 * spectrum.max()
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-12 * spectrum.max()


def test_minres_solves():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    a = (q * np.r_[-3, -1, np.arange(1, 11)]) @ q.T
    b = rng.standard_normal((12, 3))
    b[:, 1] = 0
    x = whitening.minres(lambda v: a @ v, b, 14)
    assert np.abs(a @ x - b).max() < 1e-2 and (x[:, 1] == 0).all()
    sizes = [np.linalg.norm(a @ whitening.minres(lambda v: a @ v, b, k) - b) for k in range(1, 12)]
    assert all(q <= p + 1e-9 for p, q in zip(sizes, sizes[1:]))


def test_query_equals_numpy(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(whitening.op12_whitening(spark, sf).collect(), rows)


def test_awkward_rows(spark, tmp_path):
    """Null, short, non-finite, repeated, null-id rows, a vector that many rows have, columns of clashing names."""
    rng = np.random.default_rng(5)
    rows = [(k, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 1]).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + [(None, rows[1][1]), (3, rows[4][1]), (3, rows[4][1])]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [math.nan] * 6), (2004, [math.inf] + [0.0] * 5), (2005, [1.0]), (2006, [1e300] + [0.0] * 5)]
    df = spark.createDataFrame(rows + odd, VECTORS)
    df.select("*", F.lit("x").alias("white"), F.lit(1).alias("x"), F.lit(1).alias("n")).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(whitening.op12_whitening(spark, str(tmp_path)).collect(), rows)
    white, model = whitening.whiten(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), 2)
    assert white.columns == ["vec_id", "embedding", "white", "x", "n", "white_"] and model.vectors.shape == (6, 2)
    assert white.filter("size(white_.whitened) = 2").count() == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])]])
def test_few_rows(spark, rows):
    """No direction, or one: what has no direction is null."""
    white, model = whitening.whiten(spark.createDataFrame(rows, VECTORS))
    got = white.collect()
    assert len(got) == sum(v is not None for _, v in rows)
    for r in got:
        assert [v is None for v in r.white.whitened] == ([False, True, True] if len(r.embedding) == 3 else [True, True])
        if len(r.embedding) == 3:
            assert abs(abs(r.white.whitened[0]) - 1) < 1e-12 and model.explained[0] == 1


def test_deviations_beyond_a_long_are_exact_or_null():
    x = np.array([[3_000_000_000, -5], [0, 0]])
    assert whitening._deviations(x, 10, [30, 40]) == [None, 30**2 + 40**2]
    assert whitening._deviations(x // 30, 10, [30, 40]) == [(10**9 - 30) ** 2 + (10 * -1 - 40) ** 2, 30**2 + 40**2]
    assert whitening._deviations(np.array([[300_000_000, 1]]), 10, [0, 0]) == [9 * 10**18 + 100]


def test_sums_are_exact(spark):
    x = spark.createDataFrame([([2**52 - k, -(2**51) + k],) for k in range(50)], "x array<long>").repartition(5)
    model = whitening.fit(x, 1)
    assert model.n == 50 and model.sums == [50 * 2**52 - 1225, -50 * 2**51 + 1225]
