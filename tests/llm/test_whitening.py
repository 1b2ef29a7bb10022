"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from dotloom.llm import whitening
from dotloom.llm.whitening import components, fit_list, whitened


def _frame(spark, rows, extra="x"):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], extra) for k, v in rows], "vec_id long, embedding array<float>, n string").repartition(3)


def _plain(v, k):
    x = np.floor(1024 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s).astype(object) ** 2).sum(axis=1), c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def _check(spark, v, got, ids):
    k = min(8, v.shape[1])
    n, deviation, w, explained = _plain(v, k)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(rows) == sorted(ids)
    mine = np.array([[rows[i][j + 1].whitened for j in range(k)] for i in ids])
    mine *= np.sign((mine * w).sum(axis=0))
    assert np.abs(mine - w).max() < 1e-8
    for i, dev in zip(ids, deviation, strict=True):
        for j in range(k):
            r = rows[i][j + 1]
            assert r.n == n and r.deviation == dev and math.isclose(r.explained, explained[j], rel_tol=1e-9) and r.identity_error < 1e-9


def test_given_vectors_equal_numpy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = d.select("vec_id", "embedding").collect()
    _check(spark, np.array([r.embedding for r in rows]), whitening.op12_whitening(spark, "/root/testdata/sf0.001"), [r.vec_id for r in rows])


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 5)).astype(np.float32)
    bad = [(100, None), (101, [1, None, 2, 3, 4]), (102, [float("nan")] * 5), (103, [float("inf"), 0, 0, 0, 0]), (104, []), (105, [1, 2, 3]), (106, [1e30] * 5)]
    _check(spark, v, whitened(_frame(spark, [*enumerate(v), *bad])), list(range(60)))


def test_repeats_null_ids_and_low_rank(spark):
    one, two = [0.5, 1.0, -2.0], [1.5, 1.0, -2.0]
    got = whitened(_frame(spark, [(1, one), (1, one), (None, two), (2, two)])).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and {abs(round(r.whitened, 9)) for r in got} == {1.0}
    assert all(math.isclose(r.explained, 1) for r in got) and {r.n for r in got} == {4} and sum(r.vec_id is None for r in got) == 1
    assert whitened(_frame(spark, [(1, one), (2, one)])).count() == 0
    empty = whitened(_frame(spark, []))
    assert empty.count() == 0 and empty.columns == [c.split()[0] for c in whitening.RESULT.split(", ")]


@pytest.mark.parametrize("fall", [0.7, 0.97])
def test_passes_end_with_certified_residuals(spark, fall):
    rng = np.random.default_rng(2)
    d = 120
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = rng.standard_normal((800, d)) * (40 * fall ** np.arange(d)) @ basis.T
    fit = fit_list(_frame(spark, list(enumerate(v))))
    c = components(fit, block=16)
    n, _, w, explained = _plain(v, 8)
    assert c.residual <= 1e-11 and np.abs(c.values / c.trace / explained - 1).max() < 1e-9
    assert 1 < c.passes < 40
    x = np.floor(1024 * v.astype(np.float32).astype(np.float64)) + 100_000
    u = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :8]
    assert np.abs(np.abs((u * c.vectors).sum(axis=0)) - 1).max() < 1e-10


def test_deviations_beyond_a_long():
    big = np.array([[3_000_000_000, 1], [4_000_000_000, 5]])
    assert whitening._deviation(big) == [9_000_000_000_000_000_001, None]
    assert whitening._deviation(np.array([[3, 4]])) == [25]
