"""Fidelity metrics, utility models and report tables against direct formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import classify, fidelity, report, utility


def tensor(seed, n):
    return np.random.default_rng(seed).normal(size=(n, 65, 3))


def frame(spark, **sets):
    rows = [(m, k, w.ravel().tolist()) for m, x in sets.items() for k, w in enumerate(x)]
    return spark.createDataFrame(rows, "method string, window_id long, features_flat array<double>")


def w1(a, b):
    x = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), x[:-1], side="right") / len(a)
    fb = np.searchsorted(np.sort(b), x[:-1], side="right") / len(b)
    return float((np.abs(fa - fb) * np.diff(x)).sum())


def test_wasserstein_and_identity(spark):
    rng = np.random.default_rng(0)
    real, far = np.round(rng.normal(size=500), 1), np.round(rng.normal(1.5, 2, size=300), 1)
    rows = [("real", "c", float(v)) for v in real] + [("far", "c", float(v)) for v in far] + [("same", "c", float(v)) for v in real]
    df = spark.createDataFrame(rows, "method string, channel string, value double")
    got = {r.method: r.wasserstein_1 for r in fidelity.wasserstein(df, ["far", "same"]).collect()}
    assert got["far"] == pytest.approx(w1(real, far)) and got["same"] == 0.0


def test_acf_skips_flat_windows(spark):
    x = tensor(1, 6)
    flat = x.copy()
    flat[0, :, 0] = 2.0
    df = frame(spark, real=x, synth=flat)
    got = fidelity.acf_table(df, False).toPandas().sort_values("lag")
    c = flat[1:, :, 0] - flat[1:, :, 0].mean(1, keepdims=True)
    want = [float(((c[:, :-k] * c[:, k:]).sum(1) / (c * c).sum(1)).mean()) for k in range(1, 21)]
    assert np.allclose(got.synthetic_acf, want)
    assert (got.synthetic_valid_windows == 5).all() and (got.real_valid_windows == 6).all()


def test_auc_counts_ties_as_half(spark):
    rng = np.random.default_rng(2)
    label = (rng.random(400) < 0.3).astype(int)
    score = np.round(rng.random(400) + 0.2 * label, 1)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(label, score)], "method string, label int, score double")
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert fidelity.roc_auc(df, ["method"]).first().roc_auc == pytest.approx(want)


def test_mmd_matches_formula(spark):
    x, y = tensor(3, 20).reshape(20, -1), tensor(4, 20).reshape(20, -1) + 0.3
    rows = [("m", True, k, v.tolist()) for k, v in enumerate(x)] + [("m", False, k, v.tolist()) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "method string, is_real boolean, id long, features_flat array<double>")
    z = np.concatenate([x, y])
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    k = np.exp(-d / np.median(d))
    want = (k[:20, :20].sum() - 20) / 380 + (k[20:, 20:].sum() - 20) / 380 - 2 * k[:20, 20:].mean()
    assert fidelity.mmd_rbf(df, "method", "id").first().mmd == pytest.approx(want)


def test_subset_is_shared_and_without_replacement(spark):
    ids = spark.range(1000).withColumnRenamed("id", "synthetic_id")
    a = sorted(r[0] for r in fidelity.common_subset(ids, "synthetic_id", 120, 42).collect())
    b = sorted(r[0] for r in fidelity.common_subset(ids.repartition(7), "synthetic_id", 120, 42).collect())
    assert a == b and len(set(a)) == 120
    other = sorted(r[0] for r in fidelity.common_subset(ids, "synthetic_id", 120, 43).collect())
    assert other != a


def test_repeats_count_values_and_surplus(spark):
    x = tensor(5, 4)
    df = frame(spark, m=np.concatenate([x, x[:1], x[:1], x[1:2]]))
    assert sorted(r.copies for r in fidelity.repeated_windows(df, ["method"]).collect()) == [2, 3]
    row = fidelity.diversity(df, ["method"]).first()
    assert (row.n_unique, row.duplicates, row.n_windows) == (4, 3, 7)


def test_histogram_integrates_to_one(spark):
    rng = np.random.default_rng(6)
    rows = [("m", "c", float(v)) for v in rng.normal(size=1000)]
    got = fidelity.histogram(spark.createDataFrame(rows, "method string, channel string, value double"), ["method"], 40).toPandas()
    width = got.left_edge.sort_values().diff().dropna().iloc[0]
    assert len(got) == 40 and got.n.sum() == 1000 and (got.density * width).sum() == pytest.approx(1)


def test_realized_vol_and_features(spark):
    x = tensor(7, 3)
    got = utility.vol_features(frame(spark, m=x), ["window_id"]).toPandas().sort_values("window_id")
    r, v = x[:, :60, 0], x[:, :60, 2]
    assert np.allclose(got.rv20, np.sqrt(252 / 20 * (r[:, -20:] ** 2).sum(1)))
    assert np.allclose(got.std_log_volume20, v[:, -20:].std(1))
    assert np.allclose(got.y, np.sqrt(252 / 5 * (x[:, 60:, 0] ** 2).sum(1)))


def test_mixture_sizes_round_half_to_even(spark):
    got = {r.ratio: r.n_synthetic for r in utility.mixture_design(F.lit(62), spark).collect()}
    assert got == {0.0: 0, 0.25: 21, 0.5: 62, 0.75: 186}


def features_frame(spark, x, y, extra=()):
    cols = [f"{c} double" for c in (*utility.FEATURES, "y")]
    return spark.createDataFrame([(*e, *map(float, a), float(b)) for e, a, b in zip(extra or [()] * len(x), x, y)], ", ".join([*(["method string", "synthetic_id long"] if extra else []), *cols]))


def test_mixture_is_nested_without_replacement_and_gated(spark):
    rng = np.random.default_rng(8)
    pool = features_frame(spark, rng.normal(size=(50, 8)), rng.normal(size=50), [("m", k) for k in range(50)])
    got = utility.mixture_rows(pool, F.lit(10), ["m"]).toPandas()
    for seed in (42, 123, 2026):
        parts = [set(got[(got.seed == seed) & (got.ratio == r)].synthetic_id) for r in (0.25, 0.5, 0.75)]
        assert [len(p) for p in parts] == [3, 10, 30] and parts[0] <= parts[1] <= parts[2]
    with pytest.raises(ValueError, match="m 50 < 90"):
        utility.mixture_rows(pool, F.lit(30), ["m"])
    with pytest.raises(ValueError, match="gone 0 < 30"):
        utility.mixture_rows(pool, F.lit(10), ["m", "gone"])


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(80, 8)) * np.arange(1, 9) + 3, rng.normal(size=80)
    rows = features_frame(spark, x, y).withColumn("method", F.lit("m"))
    model = utility.solve_ridge(utility.moments(rows, ["method"]), ["method"], None).first()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(8), z.T @ (y - y.mean()))
    assert np.allclose(model.coef, w)
    pred = y.mean() + z @ w
    score = utility.score_models(spark.createDataFrame([model]), rows, ["method"]).first()
    assert score.rmse == pytest.approx(np.sqrt(((pred - y) ** 2).mean()))
    assert score.mae == pytest.approx(np.abs(pred - y).mean())


@pytest.mark.parametrize(
    "r, n, p", [(0.5, 10, 0.141112), (0.9, 5, 0.037386), (-0.3, 12, 0.343436), (0.997, 3, 0.049319), (0.6, 4, 0.4), (1.0, 6, 0.0)]
)
def test_p_values_of_correlations(spark, r, n, p):
    df = spark.createDataFrame([(r, n)], "r double, n long")
    assert report.with_two_sided_p(df, "r", "n", "p").first().p == pytest.approx(p, abs=2e-5)


def test_summary_and_reports(spark):
    raw = [("REAL_ONLY", 0.0, None, 2.0, 1.0)]
    for k, m in enumerate(report.METHOD_ORDER):
        raw += [(m, r, s, 1.0 + 0.1 * k + r + 0.01 * s, 0.5 + r) for r in (0.25, 0.5, 0.75) for s in (1, 2, 3)]
    df = spark.createDataFrame(raw, "method string, ratio double, seed int, rmse double, mae double")
    master = report.master_utility(utility.downstream_summary(df))
    best = report.model_summary(master, report.seed_stability(df)).where("method_id = 'bootstrap_jitter'").first()
    assert best.best_rmse_ratio == 0.25 and best.best_rmse_mean == pytest.approx(1.27)
    assert best.best_rmse_improvement_pct == pytest.approx((2 - 1.27) / 2 * 100)
    assert all(r.matches and not r.has_null for r in report.sanity_check(master).collect())
    with pytest.raises(Exception, match="exactly one real-only row"):
        report.master_utility(utility.downstream_summary(df.unionByName(df)).unionByName(utility.downstream_summary(df))).collect()
    gaps = report.grid_completeness(df.where("not (method = 'ar1_jitter' and seed = 3)"), ["ar1_jitter"], (0.25, 0.5, 0.75), (1, 2, 3))
    assert gaps.where("method = 'ar1_jitter'").first().n_missing == 3


def test_out_of_fold_scores_cover_every_row_once(spark):
    rng = np.random.default_rng(10)
    real = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(40)], "row_id long, features_flat array<double>")
    fake = spark.createDataFrame([("m", k, (rng.normal(size=4) + 3).tolist()) for k in range(40)], "method string, row_id long, features_flat array<double>")
    pairs = classify.with_folds(classify.labelled_pairs(real, fake, "method", ["m"]), "method")
    scores = classify.out_of_fold_scores(pairs, "method", ["m"])
    assert scores.count() == 80 and scores.select("label", "row_id").distinct().count() == 80
    assert fidelity.roc_auc(scores, ["method"]).first().roc_auc > 0.95


def direct_pairs(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(len(x), k=1)]
    q = np.percentile(d, [1, 5, 50, 95])
    return [len(d), d.mean(), q[2], d.std(), d.min(), q[0], q[1], q[3], d.max()]


@pytest.mark.parametrize("tile_rows", [2048, 100])
def test_pair_statistics_use_every_row(spark, tile_rows):
    """More rows than any earlier sample size, in one tile and in many."""
    from tickloom.operators import pairs

    rng = np.random.default_rng(8)
    x = {"a": rng.normal(size=(700, 5)), "b": rng.normal(size=(30, 5)).repeat(2, axis=0)}
    rows = [(m, k, v.tolist()) for m, vs in x.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "method string, id long, features_flat array<double>")
    for r in pairs.pairwise_distances(df, "method", "id", tile_rows=tile_rows).collect():
        assert list(r)[1:] == pytest.approx(direct_pairs(x[r.method]), abs=1e-9)


def test_mmd_uses_every_row(spark):
    from tickloom.operators import pairs

    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(600, 4)), rng.normal(0.2, 1, size=(650, 4))
    rows = [("m", True, k, v.tolist()) for k, v in enumerate(x)] + [("m", False, k, v.tolist()) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "method string, is_real boolean, id long, features_flat array<double>")
    z = np.concatenate([x, y])
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    k = np.exp(-d / np.median(d))
    n, m = 600, 650
    want = (k[:n, :n].sum() - n) / (n * (n - 1)) + (k[n:, n:].sum() - m) / (m * (m - 1)) - 2 * k[:n, n:].mean()
    got = pairs.mmd_rbf(df, "method", "id", tile_rows=256).first()
    assert got.gamma == pytest.approx(1 / np.median(d)) and got.mmd == pytest.approx(want) and (got.n_real, got.n_synthetic) == (n, m)


def logistic_fit(x, y):
    """L2 logistic regression (C = 1, free intercept) by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    return w


def test_two_sample_classifier_matches_a_direct_fit(spark):
    from tickloom.operators import classify

    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(90, 6)) * 3 + 1, rng.normal(0.4, 1, size=(90, 6)) * 3 + 1])
    rows = [("real" if k < 90 else "m", k % 90, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "method string, row_id long, features_flat array<double>")
    pairs = classify.with_folds(classify.labelled_pairs(df.where("method = 'real'"), df.where("method = 'm'"), "method", ["m"]), "method", 5)
    place = {(r.label, r.row_id): r.fold for r in pairs.collect()}
    got = {(r.label, r.row_id): r.score for r in classify.out_of_fold_scores(pairs, "method", ["m"]).collect()}
    label, fold = np.repeat([0, 1], 90), np.array([place[(k // 90, k % 90)] for k in range(180)])
    want = np.empty(180)
    for f in range(5):
        train, test = fold != f, fold == f
        mean, std = x[train].mean(0), x[train].std(0)
        w = logistic_fit((x[train] - mean) / std, label[train])
        want[test] = 1 / (1 + np.exp(-(np.column_stack([(x[test] - mean) / std, np.ones(test.sum())]) @ w)))
    assert [got[(k // 90, k % 90)] for k in range(180)] == pytest.approx(want, abs=2e-3)
    scores = spark.createDataFrame([("m", a, s) for (a, _), s in got.items()], "method string, label int, score double")
    auc = (want[label == 1][:, None] > want[label == 0][None]).mean()
    assert fidelity.roc_auc(scores, ["method"]).first().roc_auc == pytest.approx(auc, abs=2e-3)


def test_unequal_classes_raise(spark):
    from tickloom.operators import classify

    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1)], "method string, label int")
    with pytest.raises(ValueError, match="unequal"):
        classify.require_equal_classes(df, "method", "label")


def test_histogram_of_a_constant_channel(spark):
    long = spark.createDataFrame([("m", "c", 2.0)] * 5, "method string, channel string, value double")
    bins = {r.bin: (r.left_edge, r.n, r.density) for r in fidelity.histogram(long, ["method"], 4).collect()}
    want, edges = np.histogram([2.0] * 5, 4, density=True)
    assert [bins[k][2] for k in range(4)] == pytest.approx(want.tolist()) and [bins[k][0] for k in range(4)] == pytest.approx(edges[:4].tolist())


def test_a_subset_larger_than_the_pool_raises(spark):
    ids = spark.range(10).withColumnRenamed("id", "synthetic_id")
    with pytest.raises(Exception, match="the subset needs 25 of 10 ids"):
        fidelity.common_subset(ids, "synthetic_id", 25, 42).collect()
