"""Whitening against eigenvectors of the covariance, bidiagonalisation on odd spectra, odd rows."""

import numpy as np
import pytest

from mensura.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x string, at int, n double"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, 2.0) for k, v in rows], SCHEMA)


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((400, 12)) * np.linspace(0.2, 3, 12)
    data[::3] = data[0]  # a third of the rows are one vector
    got = whitening.whiten(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)]).repartition(5), wanted=8).toPandas()
    x = np.floor(64 * data) + 1_000_000
    centred = x - x.mean(axis=0)
    values, components = np.linalg.eigh(centred.T @ centred / len(x))
    values, components = values[::-1], components[:, ::-1]
    want = centred @ components[:, :8] / np.sqrt(values[:8])
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(wide * np.sign((wide * want).sum(axis=0)) - want).max() < 1e-9
    first = got[got.component == 1].sort_values("vec_id")
    exact = [sum((400 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    assert first.deviation.tolist() == exact and set(got.n) == {400}
    assert np.allclose(got.explained[:8], values[:8] / values.sum(), rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


@pytest.mark.parametrize("spectrum", [[9.0, 9.0, 9.0, 4.0] + [1 / (1 + i) for i in range(76)], [1.0] * 30, [3.0, 2.0, 1.0] + [0.0] * 27,
                                      [10.0 ** -i for i in range(40)]])
def test_bidiagonalisation_finds_equal_and_vanishing_values(spectrum):
    rng = np.random.default_rng(5)
    d = len(spectrum)
    outer, inner = np.linalg.qr(rng.standard_normal((200, d)))[0], np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = outer @ np.diag(spectrum) @ inner.T
    values, right = whitening.bidiagonalise(lambda p: ((u := x @ p) @ u, x.T @ u), d, 6)
    want = np.array([s for s in sorted(spectrum, reverse=True)[:6] if s > 0])
    assert np.allclose(values, want, rtol=1e-9)
    assert np.allclose(right.T @ right, np.eye(len(values)), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ right, axis=0), values, rtol=1e-9)


def test_odd_vectors(spark):
    odd = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (3, None), (4, [1.0, float("nan")]), (5, [1.0, None]),
           (6, [1e300, 1.0]), (7, []), (8, [1.0]), (9, [float("inf"), 0.0])]
    got = whitening.whiten(vectors(spark, odd)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.component, r.n, r.deviation) for r in got if r.vec_id) == [
        (False, 1, 1, 3, 128**2), (False, 1, 1, 3, 128**2)]
    assert [(r.component, r.deviation, round(abs(r.whitened), 6)) for r in got if r.vec_id is None] == [(1, 256**2, 1.414214)]
    for rows in ([], [(1, [1.0, 2.0])], [(1, None)], [(1, [1.0]), (2, [1.0])]):
        out = whitening.whiten(vectors(spark, rows))
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # Sums of squares beyond a long have no deviation, all below are exact.
    far = whitening.whiten(vectors(spark, [(1, [6e13]), (2, [-6e13]), (3, [0.0])])).collect()
    assert {r.vec_id: r.deviation for r in far} == {1: None, 2: None, 3: 0}
    near = whitening.whiten(vectors(spark, [(1, [1e7]), (2, [-1e7]), (3, [0.0])])).collect()
    assert {r.vec_id: r.deviation for r in near} == {1: (3 * 64 * 10**7) ** 2, 2: (3 * 64 * 10**7) ** 2, 3: 0}
