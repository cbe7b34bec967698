"""Mixture fits over many tasks against a direct one from the same start."""

import numpy as np
import pytest

from tickloom.operators import mixture


def made(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 5.0], [4, -3, 0], [-5, 2, 1]])
    pick = rng.integers(0, 3, n)
    return centres[pick] + rng.normal(size=(n, 3)) * np.array([1.0, 0.5, 0.2])[pick, None] + 50


def table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, z array<double>").repartition(6)


def direct(x, means, floor, tolerance):
    n, d = x.shape
    k = len(means)
    cov = np.repeat((np.cov(x.T, bias=True) + floor * np.eye(d))[None], k, axis=0)
    weights, history = np.full(k, 1 / k), []
    while True:
        dens = np.stack([weights[j] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - means[j], np.linalg.inv(cov[j]), x - means[j])) / np.sqrt(np.linalg.det(2 * np.pi * cov[j])) for j in range(k)], axis=1)
        history.append(np.log(dens.sum(axis=1)).mean())
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            return weights, means, cov, history
        r = dens / dens.sum(axis=1, keepdims=True)
        counts = r.sum(axis=0)
        weights, means = counts / n, (r.T @ x) / counts[:, None]
        cov = np.stack([((r[:, j, None] * (x - means[j])).T @ (x - means[j])) / counts[j] + floor * np.eye(d) for j in range(k)])


@pytest.mark.parametrize("floor", [1e-4, 0.3])
def test_fit_equals_a_direct_one(spark, floor):
    x = made(1)
    start = x[[3, 77, 200]]
    got = mixture.fit(table(spark, x), "id", "z", 3, 0, floor=floor, tolerance=1e-9, means=[start])
    weights, means, cov, history = direct(x, start, floor, 1e-9)
    assert np.allclose(got.weights, weights, atol=1e-6) and np.allclose(got.means, means, atol=1e-6) and np.allclose(got.covariances, cov, atol=1e-6)
    assert np.allclose(got.history, history, atol=1e-6)
    assert all(np.linalg.eigvalsh(c).min() >= floor * (1 - 1e-9) for c in got.covariances)


def test_likelier_start_is_kept(spark):
    x = made(2)
    poor = np.repeat(x[:1], 3, axis=0)  # equal starts never part
    good = x[[3, 77, 200]]
    alone = mixture.fit(table(spark, x), "id", "z", 3, 0, means=[good])
    both = mixture.fit(table(spark, x), "id", "z", 3, 0, means=[poor, good])
    assert np.allclose(both.means, alone.means) and both.history == pytest.approx(alone.history)


def test_starts_depend_on_the_rows_alone(spark):
    x = made(3)
    a = mixture.starting_points(table(spark, x), "id", "z", 4, 1)
    b = mixture.starting_points(table(spark, x).repartition(2), "id", "z", 4, 1)
    assert (a == b).all() and len(np.unique(a, axis=0)) == 4


def test_copies_of_one_row_are_held_by_the_floor(spark):
    got = mixture.fit(table(spark, np.ones((50, 2))), "id", "z", 2, 0)
    assert np.isfinite(got.history).all() and np.allclose(got.covariances, 1e-4 * np.eye(2))
