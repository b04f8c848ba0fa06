"""Operator 12 against a dense eigendecomposition."""

import math
import random

import numpy as np
import pytest

from textindex.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def brute(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = (x * n - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], axes[:, ::-1]


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def random_vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    scale = np.geomspace(2.0, 0.02, d)
    return (rng.standard_normal((n, d)) * scale @ np.linalg.qr(rng.standard_normal((d, d)))[0]).tolist()


@pytest.mark.parametrize("n, d", [(200, 40), (300, 12), (60, 3)])
def test_against_dense(spark, n, d):
    vectors = random_vectors(n, d)
    quantized = whitening.quantized(table(spark, vectors))
    model = whitening.fit(quantized, guards=8)
    rows = whitening.whiten(quantized, model).collect()
    count, deviation, centred, values, axes = brute(vectors)
    k = min(8, d)
    assert len(rows) == n * k and model.identity_error <= 1e-10
    assert np.allclose(model.values, values[:k], rtol=1e-11)
    assert np.allclose(np.abs((model.components * axes[:, :k]).sum(axis=0)), 1, atol=1e-12)
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign((model.components * axes[:, :k]).sum(axis=0))
    for r in rows:
        assert (r.n, r.deviation) == (count, deviation[r.vec_id])
        assert abs(r.whitened * signs[r.component - 1] - want[r.vec_id, r.component - 1]) < 1e-8
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10


def test_direction_missing_from_the_block_is_found(spark, monkeypatch):
    """The first block lacks the leading direction; fresh vectors bring it in."""
    vectors = np.array(random_vectors(400, 30, seed=2)) * 0.05
    vectors[:, 0] += np.random.default_rng(3).standard_normal(400) * 9
    real = np.random.default_rng

    class Blind:
        def __init__(self, seed):
            self.drawn, self.rng = 0, real(seed)

        def standard_normal(self, shape):
            out = self.rng.standard_normal(shape)
            if not self.drawn:
                out[0] = 0
            self.drawn += 1
            return out

    quantized = whitening.quantized(table(spark, vectors.tolist()))
    monkeypatch.setattr(whitening.np.random, "default_rng", Blind)
    model = whitening.fit(quantized, components=2, guards=4)
    monkeypatch.undo()
    _, _, _, values, _ = brute(vectors.tolist())
    assert np.allclose(model.values, values[:2], rtol=1e-10)


def test_dropped_and_degenerate(spark):
    good = random_vectors(20, 4)
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, None, None, None) for i, v in enumerate(good)] + [(None, v, 1, "x", 2) for v in odd] \
        + [(None, good[0], 1, "x", 2)]
    quantized = whitening.quantized(spark.createDataFrame(rows, SCHEMA))
    got = whitening.whiten(quantized, whitening.fit(quantized)).collect()
    assert len(got) == 21 * 4 and {r.n for r in got} == {21}
    assert sorted(r.whitened for r in got if r.vec_id is None) == pytest.approx(
        sorted(r.whitened for r in got if r.vec_id == 0), abs=1e-9)

    # one vector, equal vectors, and a dimension that depends on another
    for vectors, live in ([good[:1], 0], [[good[0]] * 5, 0], [[[a, a, 0.5] for a in (0.0, 1.0, 3.0)], 1]):
        quantized = whitening.quantized(table(spark, vectors))
        got = whitening.whiten(quantized, whitening.fit(quantized)).collect()
        assert len(got) == len(vectors) * len(vectors[0])
        assert sum(r.whitened is not None for r in got) == live * len(vectors)
        assert all(r.identity_error < 1e-9 for r in got)


def test_empty(spark):
    for rows in ([], [(1, None, 1, "x", 2)]):
        quantized = whitening.quantized(spark.createDataFrame(rows, SCHEMA))
        assert whitening.whiten(quantized, whitening.fit(quantized)).collect() == []


def test_huge_entries(spark):
    vectors = random_vectors(9, 3)
    vectors[0][0], vectors[1][1] = 3e38, -3e38
    quantized = whitening.quantized(table(spark, vectors))
    got = whitening.whiten(quantized, whitening.fit(quantized)).collect()
    assert {r.deviation is None for r in got} == {True}
    assert all(abs(r.whitened) < 10 for r in got if r.whitened is not None)


def test_exact_deviation_of_unequal_sizes(spark):
    rng = random.Random(8)
    vectors = [[rng.uniform(-50, 50) for _ in range(6)] for _ in range(40)]
    quantized = whitening.quantized(table(spark, vectors))
    got = {r.vec_id: r.deviation for r in whitening.whiten(quantized, whitening.fit(quantized)).collect()}
    assert [got[i] for i in range(40)] == brute(vectors)[1]
