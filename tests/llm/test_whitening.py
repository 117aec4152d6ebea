"""Whitening against exact fractions and a dense eigendecomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sladd.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, i int, whitened string, high string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], SCHEMA)


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for low, high, n in ((-5, 5, 1), (-40, 90, 130), (0, 1, 64), (-(1 << 59), 1 << 59, 50), (7, 8, 65)):
        x = rng.integers(low, high, (n, 4))
        count, sums, products = W.scatter(x)
        exact = x.astype(object)
        assert count == n and sums.tolist() == exact.sum(axis=0).tolist()
        assert products.tolist() == exact.T.dot(exact).tolist()


@pytest.mark.parametrize("partitions", [1, 6])
def test_against_dense(spark, partitions):
    rng = np.random.default_rng(partitions)
    data = (rng.normal(size=(700, 6)) @ rng.normal(size=(6, 6)) * 0.2 + 3).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(data)]
    rows += [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] + [1.0] * 5), (904, [math.inf] + [1.0] * 5), (905, [1.0] * 5)]
    vectors = frame(spark, rows).repartition(partitions)
    model = W.fit(vectors, components=4)
    x = np.floor(64 * data.astype(float)).astype(int)
    n, sums = len(x), x.sum(axis=0)
    exact = [[Fraction(int(n * (x[:, i] * x[:, j]).sum() - sums[i] * sums[j]), n * n) for j in range(6)] for i in range(6)]
    values, directions = np.linalg.eigh(np.array([[float(c) for c in r] for r in exact]))
    assert model.n == n and np.allclose(model.values, values[::-1][:4], rtol=1e-12)
    assert np.allclose(model.explained, values[::-1][:4] / values.sum(), rtol=1e-12)
    white = W.whiten(vectors, model)
    got = {r.vec_id: r for r in white.collect()}
    assert sorted(got) == list(range(n))
    z = (x - sums / n) @ directions[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    found = np.array([got[k].whitened for k in range(n)])
    sign = np.sign((found * z).sum(axis=0))
    assert np.allclose(found, z * sign, atol=1e-9)
    for k in range(0, n, 50):
        assert int(got[k].deviation) == sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[k], sums))
    assert W.identity_error(white, model) < 1e-9


def test_offset_cancels(spark):
    rng = random.Random(5)
    rows = [[rng.randint(-9, 9) / 64, rng.randint(-9, 9) / 64] for _ in range(200)]
    a, b = (W.fit(frame(spark, [(0, [c + shift for c in r]) for r in rows])) for shift in (0.0, 65536.0))
    assert np.array_equal(a.values, b.values) and a.n == b.n


def test_flat_directions(spark):
    same = frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (2, [0.5, 0.25])])
    model = W.fit(same)
    white = W.whiten(same, model)
    assert sorted((r.vec_id, int(r.deviation), r.whitened) for r in white.collect()) == [(1, 0, [0.0, 0.0]), (2, 0, [0.0, 0.0]), (2, 0, [0.0, 0.0])]
    assert W.identity_error(white, model) == 0.0 and model.explained.tolist() == [0.0, 0.0]
    line = frame(spark, [(k, [k / 64, 2 * k / 64, 1.0]) for k in range(9)])
    model = W.fit(line)
    assert (model.values > 0).tolist() == [True, False, False] and W.identity_error(W.whiten(line, model), model) < 1e-9


def test_extremes(spark):
    rows = [(k, [s * 3e38, s * 1e15, 1.0]) for k, s in enumerate((1, -1, 1))]
    model = W.fit(frame(spark, rows))
    got = W.whiten(frame(spark, rows), model).collect()
    assert len(got) == 3 and all(math.isfinite(c) for r in got for c in r.whitened) and got[0].deviation is not None


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        model = W.fit(frame(spark, rows))
        white = W.whiten(frame(spark, rows), model)
        assert model is None and white.count() == 0 and W.identity_error(white, model) is None
