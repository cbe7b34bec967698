"""Many logistic fits in the same passes against one direct fit each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import classify, logit

SCHEMA = "method string, label int, row_id long, fold int, features_flat array<double>"


def direct(x, y, z, standardize=True):
    """Probabilities of ``z`` from Newton steps on (x, y), C = 1, with halved steps."""
    if standardize:
        mean, std = x.mean(0), x.std(0)
        scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        x, z = (x - mean) * scale, (z - mean) * scale
    x, z = (np.column_stack([a, np.ones(len(a))]) for a in (x, z))
    penalty = np.append(np.ones(x.shape[1] - 1), 0.0)
    value = lambda w: np.logaddexp(0, -np.where(y == 1, 1, -1) * (x @ w)).sum() + 0.5 * (penalty * w * w).sum()
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-10 * (penalty == 0)), x.T @ (p - y) + penalty * w)
        while value(w - step) > value(w) + 1e-12 * abs(value(w)):
            step /= 2
        w = w - step
    return 1 / (1 + np.exp(-z @ w))


def made(seed, shift, n=60, width=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(2 * n, width)) @ rng.normal(size=(width, width)) * 10.0 ** rng.integers(-3, 3, width) + 100
    x[:, 3] = 7.0  # a constant feature
    y = np.repeat([0, 1], n)
    x[n:, 0] += shift * x[:, 0].std()
    fold = np.tile(np.arange(3), 2 * n)[: 2 * n]
    return x, y, fold


def rows_of(spark, groups):
    rows = [(g, int(b), k, int(f), a.tolist()) for g, (x, y, fold) in groups.items() for k, (a, b, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("per_task, fan_in", [(8000, 64), (20, 3)])
def test_fits_equal_direct_ones(spark, monkeypatch, per_task, fan_in):
    monkeypatch.setattr(logit, "ROWS_PER_TASK", per_task)
    monkeypatch.setattr(logit, "FAN_IN", fan_in)
    groups = {"same": made(1, 0.0), "near": made(2, 1.0), "apart": made(3, 9.0)}
    fits = logit.Fits(rows_of(spark, groups), "method", list(groups), 3)
    assert fits.passes <= 12
    got = {(r.method, r.row_id): (r.score, r.label, r.fold) for r in fits.held_out_scores().collect()}
    assert len(got) == sum(len(x) for x, _, _ in groups.values())
    for g, (x, y, fold) in groups.items():
        for f in range(3):
            out = np.flatnonzero(fold == f)
            wanted = direct(x[fold != f], y[fold != f], x[out])
            assert np.allclose([got[g, k][0] for k in out], wanted, atol=1e-8)
            assert all(got[g, k][1:] == (y[k], f) for k in out)


def test_one_fold_is_a_holdout(spark):
    x, y, fold = made(4, 1.0)
    rows = rows_of(spark, {"m": (x, y, np.minimum(fold, 1))})
    got = {r.row_id: r.score for r in classify.out_of_fold_scores(rows, "method", ["m"], folds=1).collect()}
    out = np.flatnonzero(fold == 0)
    assert sorted(got) == out.tolist() and np.allclose([got[k] for k in out], direct(x[fold != 0], y[fold != 0], x[out]), atol=1e-8)


def test_fit_on_leading_components(spark):
    x, y, _ = made(5, 2.0)
    fold = np.arange(len(x)) % 10
    got = classify.discriminative_score(rows_of(spark, {"m": (x, y, fold)}), "method", ["m"], components=4).first()
    train, out = fold >= 3, fold < 3
    pc = np.linalg.eigh(np.cov(x[train].T))[1][:, ::-1][:, :4]
    centre = x[train].mean(0)
    wanted = ((direct((x[train] - centre) @ pc, y[train], (x[out] - centre) @ pc, False) >= 0.5) == (y[out] == 1)).mean()
    assert got.n == out.sum() and got.accuracy == pytest.approx(wanted)


def test_uneven_classes_and_missing_groups_are_errors(spark):
    rows = rows_of(spark, {"m": made(6, 1.0)})
    with pytest.raises(ValueError, match="unequal"):
        classify.out_of_fold_scores(rows.where("NOT (label = 1 AND row_id % 5 = 0)"), "method", ["m"], 3)
    with pytest.raises(ValueError, match="no training rows"):
        logit.Fits(rows, "method", ["m", "none"], 3)


def test_passes_keep_no_rows_in_memory(spark):
    rows = rows_of(spark, {"m": made(7, 1.0)})
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    classify.out_of_fold_scores(rows, "method", ["m"], 3).agg(F.count(F.lit(1))).first()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
