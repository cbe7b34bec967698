"""Queries: volatility features, mixtures, ridge scores and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import PROTOCOL
from ..functions.arrays import r6
from ..operators import candidates, classify, contract, fidelity as fid, report, resample, scaling, utility, validity, windows as win
from ..operators.sequence import quantiles
from ..session import stage
from .inputs import POOLS, Inputs, query
from .oracle import DONORS, FEATURES, XS, r6 as R, sql
from .q_fidelity import evaluation_long, rounded
from .q_resample import jitter_candidates, name_parts

METHODS = [m for m, _, _ in POOLS]
KEY = ["method", "ratio", "seed"]


def seed_text():
    return F.coalesce(F.col("seed").cast("string"), F.lit("none")).alias("seed")


SEED_SQL = "CASE WHEN seed = 0 THEN 'none' ELSE seed::VARCHAR END AS seed"


@query(
    "vol_features",
    sql(
        "realvf synvf testvf",
        f"""
SELECT source, row_id, {', '.join(R(c, c) for c in (*FEATURES, 'y'))} FROM (
  SELECT 'test' AS source, test_row AS row_id, {XS}, y FROM testvf UNION ALL SELECT method, id, {XS}, y FROM synvf
  UNION ALL SELECT 'visible', start_pos, {XS}, y FROM realvf)""",
    ),
)
def vol_features(i: Inputs) -> DataFrame:
    parts = [
        utility.vol_features(i.split("visible"), ["start_pos"]).select(F.lit("visible").alias("source"), F.col("start_pos").alias("row_id"), *FEATURES, "y"),
        utility.vol_features(i.test_windows, ["test_row"]).select(F.lit("test").alias("source"), F.col("test_row").alias("row_id"), *FEATURES, "y"),
        utility.vol_features(i.valid_pools, ["method", "synthetic_id"], "calibrated").select(
            F.col("method").alias("source"), F.col("synthetic_id").alias("row_id"), *FEATURES, "y"
        ),
    ]
    return rounded(reduce(DataFrame.unionByName, parts), ["source", "row_id"], [*FEATURES, "y"])


@query(
    "feature_describe",
    sql(
        "synvf",
        " UNION ALL ".join(
            f"""SELECT method, '{c}' AS feature, count(*) AS n, bool_and(isfinite({c})) AS all_finite, {R(f'avg({c})', 'mean')}, {R(f'stddev_samp({c})', 'std')},
  {R(f'min({c})', 'min')}, {R(f'quantile_cont({c}, 0.25)', 'p25')}, {R(f'median({c})', 'p50')}, {R(f'quantile_cont({c}, 0.75)', 'p75')}, {R(f'max({c})', 'max')} FROM synvf GROUP BY 1"""
            for c in (*FEATURES, "y")
        ),
    ),
)
def feature_describe(i: Inputs) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in (*FEATURES, "y")])
    long = i.synthetic_features.select("method", F.explode(cells).alias("c")).select("method", "c.feature", "c.x")
    stats = long.groupBy("method", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("x").isNotNull() & ~F.isnan("x")).alias("all_finite"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    quarters = quantiles(long, ["method", "feature"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    names = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return rounded(stats.join(quarters, ["method", "feature"]), ["method", "feature", "n", "all_finite"], names)


@query("mixture_design", sql("design", f"SELECT {R('ratio', 'ratio')}, n_real, n_synthetic FROM design"))
def mixture_design(i: Inputs) -> DataFrame:
    n_real = i.split("visible").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return utility.mixture_design(n_real, i.spark)


@query("mixtures", sql("mixsyn", f"SELECT method, ratio, seed, id AS synthetic_id, {R('rv20', 'rv20')}, {R('y', 'y')} FROM mixsyn"))
def mixtures(i: Inputs) -> DataFrame:
    return i.mixtures.select("method", "ratio", "seed", "synthetic_id", r6("rv20").alias("rv20"), r6("y").alias("y"))


@query(
    "feature_scaler",
    sql("realvf", " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'avg({c})', 'mean')}, {R(f'stddev_pop({c})', 'std')} FROM realvf" for c in FEATURES)),
)
def feature_scaler(i: Inputs) -> DataFrame:
    return rounded(utility.scaler(i.real_features), ["feature"], ["mean", "std"])


COEFS = [f"coef_{c}" for c in FEATURES]


@query(
    "ridge_fit",
    sql(
        "models",
        f"SELECT method, ratio, {SEED_SQL}, n, {', '.join(R(f'coef[{k + 1}]', c) for k, c in enumerate(COEFS))}, {R('intercept', 'intercept')} FROM models",
    ),
)
def ridge_fit(i: Inputs) -> DataFrame:
    cols = [r6(F.get("coef", F.lit(k))).alias(c) for k, c in enumerate(COEFS)]
    return i.models.select("method", "ratio", seed_text(), "n", *cols, r6("intercept").alias("intercept"))


@query("rmse_mae", sql("raw", f"SELECT method, {R('avg(rmse)', 'rmse')}, {R('avg(mae)', 'mae')}, any_value(n_test) AS n_test FROM raw GROUP BY 1"))
def rmse_mae(i: Inputs) -> DataFrame:
    n_test = i.test_features.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    scores = utility.score_models(i.models, i.test_features, KEY)
    return scores.groupBy("method").agg(r6(F.avg("rmse")).alias("rmse"), r6(F.avg("mae")).alias("mae")).withColumn("n_test", n_test)


@query("downstream_raw", sql("raw", f"SELECT method, ratio, {SEED_SQL}, {R('rmse', 'rmse')}, {R('mae', 'mae')} FROM raw"))
def downstream_raw(i: Inputs) -> DataFrame:
    return i.raw_results.select("method", "ratio", seed_text(), r6("rmse").alias("rmse"), r6("mae").alias("mae"))


SUMMARY_NAMES = ["mean_rmse", "std_rmse", "mean_mae", "std_mae", "delta_rmse", "delta_rmse_pct", "delta_mae", "delta_mae_pct"]


@query("downstream_summary", sql("usummary", f"SELECT method, ratio, {', '.join(R(c, c) for c in SUMMARY_NAMES)} FROM usummary"))
def downstream_summary(i: Inputs) -> DataFrame:
    return rounded(i.summary, ["method", "ratio"], SUMMARY_NAMES)


@query(
    "interpretation",
    sql(
        "usummary validity",
        f"""
SELECT s.method, s.ratio, {R('mean_rmse', 'mean_rmse')}, {R('delta_rmse_pct', 'delta_rmse_pct')}, {R('mean_mae', 'mean_mae')}, {R('delta_mae_pct', 'delta_mae_pct')}, {R('v.invalid', 'invalid_rate')}
FROM usummary s JOIN (SELECT method, avg(CASE WHEN ok THEN 0.0::DOUBLE ELSE 1.0 END) AS invalid FROM validity GROUP BY 1) v USING (method)
QUALIFY row_number() OVER (PARTITION BY s.method ORDER BY mean_rmse) = 1""",
    ),
)
def interpretation(i: Inputs) -> DataFrame:
    valid = validity.validity_summary(i.calibrated, ["method"], "calibrated")
    return rounded(utility.interpretation(i.summary, valid), ["method", "ratio"], ["mean_rmse", "delta_rmse_pct", "mean_mae", "delta_mae_pct", "invalid_rate"])


def own_scale_models(i: Inputs, share: float) -> DataFrame:
    """Visible, full history and the mixtures of one share, each scaled by its own rows."""
    named = lambda df, name: df.select(name.alias("method"), *FEATURES, "y")
    full = utility.vol_features(i.split("full_history"), [])
    mixed = i.mixtures.where((F.abs(F.col("ratio") - share) < 1e-9) & (F.col("seed") == 42))
    sets = [
        named(i.real_features, F.lit("visible")),
        named(full, F.lit("full_history")),
        named(mixed, F.col("method")),
        i.real_features.select(F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"), *FEATURES, "y"),
    ]
    stats = utility.moments(reduce(DataFrame.unionByName, sets), ["method"])
    return stage(utility.solve_ridge(stats, ["method"], None), "full_models")


@query(
    "full_history_benchmark",
    sql("fullraw fullmodels", f"SELECT method, n AS n_train, {R('rmse', 'rmse')}, {R('mae', 'mae')} FROM fullraw JOIN fullmodels USING (method, ratio, seed)"),
)
def full_history_benchmark(i: Inputs) -> DataFrame:
    models = own_scale_models(i, 0.75)
    scores = utility.score_models(models, i.test_features, ["method"])
    both = scores.join(models.select("method", F.col("n").alias("n_train")), "method")
    return rounded(both, ["method", "n_train"], ["rmse", "mae"])


@query(
    "coef_table",
    sql("halfmodels", " UNION ALL ".join(f"SELECT method, '{c}' AS feature, {R(f'coef[{k + 1}]', 'coefficient')} FROM halfmodels" for k, c in enumerate(FEATURES))),
)
def coef_table(i: Inputs) -> DataFrame:
    """Coefficients of the real, the even mixtures' and the full-history fits, feature by feature."""
    return rounded(utility.coef_table(own_scale_models(i, 0.5)), ["method", "feature"], ["coefficient"])


@query(
    "coef_cosine",
    sql(
        "halfmodels",
        f"""
SELECT a.method, {R("""list_sum(list_transform(a.coef, lambda x, i: x * b.coef[i])) / sqrt(list_sum(list_transform(a.coef, lambda x: x * x)) * list_sum(list_transform(b.coef, lambda x: x * x)))""", 'cosine')}
FROM halfmodels a, halfmodels b WHERE a.method <> 'full_history' AND b.method = 'full_history'""",
    ),
)
def coef_cosine(i: Inputs) -> DataFrame:
    """How near each fit's coefficients point to those of the fit on the full history."""
    return rounded(utility.coef_cosine(own_scale_models(i, 0.5), "full_history"), ["method"], ["cosine"])


# --- candidates ------------------------------------------------------------

SWEEP = [s for s in candidates.GRID if s.family == "bootstrap_temporal" and s.rho == 0.85]
SWEEP_SQL = ", ".join(f"('{s.name}', {s.sigma}::DOUBLE)" for s in SWEEP)
# The candidates that a decision is taken between.
SHORTLIST = (
    "baseline_jitter_0p05", "temporal_jitter_0p25_rho0p85", "temporal_jitter_0p30_rho0p85", "temporal_jitter_0p40_rho0p85",
    "temporal_jitter_0p50_rho0p85", "pca_gmm_32c12",
)


def sweep_pool(i: Inputs) -> DataFrame:
    draws = resample.draw_indices(i.spark, 0, i.n_donors, F.lit(i.n_donors), 42)
    plain = resample.bootstrap(i.donors, draws).select("synthetic_id", "features_flat")
    return stage(candidates.jitter_family(plain, 42, SWEEP, i.donor_cholesky), "sweep")


def candidate_table(i: Inputs, pools: DataFrame) -> DataFrame:
    """Fidelity of the shared subset and validity of the whole pool, per candidate."""
    names = [s.name for s in candidates.GRID]
    picked = fid.apply_subset(pools, i.subset, "synthetic_id").select("method", F.col("synthetic_id").alias("window_id"), "features_flat")
    both = stage(i.real_rows.unionByName(picked), "candidate_eval")
    present = [n for n in names if n in {r[0] for r in pools.select("method").distinct().collect()}]
    steps = win.sessions(both, ["method"])
    w1 = fid.wasserstein(win.unpivot_channels(steps, ["method"]), present).groupBy("method").agg(F.avg("wasserstein_1").alias("mean_wasserstein"))
    corr = fid.corr_errors(fid.channel_corr(steps, ["method"])).select("method", F.col("mean_abs_off_diagonal").alias("corr_mae"))
    valid = validity.validity_summary(scaling.denormalize(pools, i.calibration, out="calibrated"), ["method", "family"], "calibrated")
    return valid.join(w1, "method", "left").join(corr, "method", "left")


SWEEP_CTES = f"""
, sp AS MATERIALIZED (SELECT g.name AS method, d.id, list_transform(n.flat, lambda x, i: x + g.sigma * z.n[i]) AS flat
  FROM (VALUES {SWEEP_SQL}) g(name, sigma), draws42 d JOIN {DONORS} n ON n.idx = d.donor_idx JOIN noise42 z ON z.id = d.id)
, se AS MATERIALIZED (SELECT method, t, flat[3*t+1] AS c0, flat[3*t+2] AS c1, flat[3*t+3] AS c2 FROM (
    SELECT 'real' AS method, flat FROM nwin WHERE split = 'donor_validation' UNION ALL SELECT method, flat FROM sp WHERE id IN (SELECT id FROM subset)), (SELECT unnest(range(65)) AS t))
, sl AS MATERIALIZED (SELECT method, ci, [c0, c1, c2][ci + 1] AS x FROM se, chan)
, sw AS (SELECT m AS method, avg(w) AS mean_wasserstein FROM (SELECT m, ci, sum(abs(cs / ns - cr / nr) * (nx - x)) AS w FROM (
    SELECT m, ci, x, sum(s) OVER o AS cs, sum(r) OVER o AS cr, sum(s) OVER p AS ns, sum(r) OVER p AS nr, lead(x) OVER o AS nx
    FROM (SELECT m, ci, x, sum((method = m)::INT)::DOUBLE AS s, sum((method = 'real')::INT)::DOUBLE AS r
          FROM sl, (SELECT DISTINCT method AS m FROM sp) WHERE method IN (m, 'real') GROUP BY 1, 2, 3)
    WINDOW o AS (PARTITION BY m, ci ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY m, ci))
  WHERE nx IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
, sc AS (SELECT a.method, (abs(a.ab - b.ab) + abs(a.ac - b.ac) + abs(a.bc - b.bc)) / 3 AS corr_mae
  FROM (SELECT method, corr(c0, c1) AS ab, corr(c0, c2) AS ac, corr(c1, c2) AS bc FROM se GROUP BY 1) a,
       (SELECT corr(c0, c1) AS ab, corr(c0, c2) AS ac, corr(c1, c2) AS bc FROM se WHERE method = 'real') b)
, sv AS (SELECT method, avg(CASE WHEN list_bool_and(list_transform(range(65), lambda t: m1 + s1 * flat[3*t+2] >= 0 AND m2 + s2 * flat[3*t+3] >= 0)) THEN 0.0::DOUBLE ELSE 1 END) AS invalid_rate FROM sp, cal GROUP BY 1)
"""
SWEEP_DEPS = "draws42 nwin noise42 subset chan cal"
SWEEP_NAMES = ["mean_wasserstein", "corr_mae", "invalid_rate"]


@query(
    "noise_sweep",
    sql(
        SWEEP_DEPS,
        SWEEP_CTES
        + f"""SELECT method, sigma AS noise_scale, 0.85::DOUBLE AS rho, invalid_rate > 0 AS has_invalid, {', '.join(R(c, c) for c in SWEEP_NAMES)}
FROM sw JOIN sc USING (method) JOIN sv USING (method) JOIN (VALUES {SWEEP_SQL}) g(method, sigma) USING (method)""",
    ),
)
def noise_sweep(i: Inputs) -> DataFrame:
    noise, rho = name_parts("method")
    table = candidate_table(i, sweep_pool(i)).withColumn("noise_scale", noise).withColumn("rho", rho)
    chosen = table.where((F.col("family") == "bootstrap_temporal") & (F.col("rho") == 0.85)).orderBy("noise_scale")
    return rounded(chosen.withColumn("has_invalid", F.col("invalid_rate") > 0), ["method", "noise_scale", "rho", "has_invalid"], SWEEP_NAMES)


BEST = ["best_ratio", "best_mean_rmse", "best_std_rmse", "best_mean_mae", "best_std_mae", "best_delta_rmse_pct", "best_delta_mae_pct"]


def candidate_pools(i: Inputs) -> DataFrame:
    """Every candidate of the grid: (method, family, synthetic_id, features_flat)."""
    mixtures = [candidates.pca_gmm(i.donors, s, i.n_donors, 42) for s in candidates.GRID if s.family == "pca_gmm"]
    return stage(reduce(DataFrame.unionByName, [jitter_candidates(i), *mixtures]), "candidates")


def candidate_scores(i: Inputs, pools: DataFrame) -> DataFrame:
    """Classifier, autocorrelation and neighbour scores of the shared subset, per candidate."""
    names = [s.name for s in candidates.GRID]
    picked = fid.apply_subset(pools, i.subset, "synthetic_id").select("method", F.col("synthetic_id").alias("window_id"), "features_flat")
    both = stage(i.real_rows.unionByName(picked), "candidate_eval")
    rows = both.withColumnRenamed("window_id", "row_id")
    pairs = classify.labelled_pairs(rows.where("method = 'real'"), rows.where("method <> 'real'"), "method", names)
    oof = classify.out_of_fold_scores(stage(classify.with_folds(pairs, "method"), "pairs"), "method", names)
    auc = fid.roc_auc(oof, ["method"]).select(
        "method", F.col("roc_auc").alias("c2st_auc"), F.abs(F.col("roc_auc") - 0.5).alias("c2st_distance_from_0p5"), F.col("accuracy").alias("c2st_accuracy")
    )
    lags = stage(fid.lag_table(both, ["method"], fid.return_series(), list(range(1, fid.MAX_LAG + 1))), "candidate_lags")
    maes = [
        fid.acf_curves(lags, absolute).groupBy("method").agg(F.first("acf_mae").alias(name))
        for name, absolute in (("return_acf_mae", False), ("abs_return_acf_mae", True))
    ]
    nn = fid.distance_summary(stage(fid.nearest_train(both, i.donors), "candidate_nn"), ["method"]).select(
        "method", F.col("median").alias("nearest_train_median"), F.col("mean").alias("nearest_train_mean")
    )
    return reduce(lambda a, b: a.join(b, "method"), [auc, *maes, nn])


def candidate_best(i: Inputs, pools: DataFrame, strict: bool = True) -> DataFrame:
    """The share with the least mean RMSE of each candidate, real-only included.

    Like every mixture, these stop with an error where a candidate has too few valid windows for
    its largest share. Without ``strict`` such a candidate has no row, and the others do.
    """
    names = [s.name for s in candidates.GRID]
    if not strict:
        sizes = validity.validity_summary(scaling.denormalize(pools, i.calibration, out="calibrated"), ["method"], "calibrated")
        need = utility.synthetic_count(F.col("n_real"), F.lit(max(PROTOCOL.shares)))
        enough = {r[0] for r in sizes.withColumn("n_real", i.n_real).where(F.col("valid") >= need).select("method").collect()}  # one name per candidate
        names = [n for n in names if n in enough]
        pools = pools.where(F.col("method").isin(*names))
    valid = scaling.denormalize(pools, i.calibration, out="calibrated").where(validity.is_valid(F.col("calibrated")))
    features = stage(utility.vol_features(valid, ["method", "synthetic_id"], "calibrated"), "candidate_features")
    sets = utility.training_sets(i.real_features, utility.mixture_rows(features, i.n_real, names), names)
    models = utility.solve_ridge(utility.moments(sets, KEY), KEY, utility.scale_row(i.real_features))
    summary = stage(utility.downstream_summary(utility.score_models(models, i.test_features, KEY)), "candidate_summary")
    real = summary.where(F.col("method") == utility.REAL_ONLY).drop("method")
    every = summary.where(F.col("method") != utility.REAL_ONLY).unionByName(real.withColumn("method", F.explode(F.array(*map(F.lit, names)))))
    of = ["ratio", "mean_rmse", "std_rmse", "mean_mae", "std_mae", "delta_rmse_pct", "delta_mae_pct"]
    best = F.min_by(F.struct(*[F.col(c).alias(n) for c, n in zip(of, BEST)]), F.struct("mean_rmse", "ratio"))
    return every.groupBy("method").agg(best.alias("b")).select("method", "b.*")


def comparison_table(i: Inputs) -> DataFrame:
    pools = candidate_pools(i)
    hashes = contract.fingerprint(pools, "method")
    parts = [candidate_table(i, pools), candidate_scores(i, pools), hashes, candidate_best(i, pools, strict=False)]
    return stage(reduce(lambda a, b: a.join(b, "method", "left"), parts), "comparison")


@query("candidate_comparison")
def candidate_comparison(i: Inputs) -> DataFrame:
    """Fidelity, validity and utility of all candidates, best first. Candidates with too few
    valid windows for the largest mixture have no utility, but their row."""
    return i.comparison.orderBy("c2st_distance_from_0p5", "mean_wasserstein", "best_mean_rmse")


@query("decision_shortlist")
def decision_shortlist(i: Inputs) -> DataFrame:
    """The candidates a decision is taken between, least error first."""
    keep = ["method", "family", "c2st_auc", "mean_wasserstein", "return_acf_mae", "abs_return_acf_mae", "invalid_rate", "best_ratio", "best_mean_rmse", "best_mean_mae"]
    return i.comparison.where(F.col("method").isin(*SHORTLIST)).select(*keep).orderBy("best_mean_rmse")


# --- reports ---------------------------------------------------------------

# Column names of the report tables.
MASTER_NAMES = ["rmse_mean", "rmse_std", "mae_mean", "mae_std", "real_only_rmse", "real_only_mae", "rmse_improvement_abs", "rmse_improvement_pct", "mae_improvement_abs", "mae_improvement_pct"]


def master(i: Inputs) -> DataFrame:
    return report.master_utility(i.summary)


def model_summary_table(i: Inputs) -> DataFrame:
    return report.model_summary(stage(master(i), "master"), report.seed_stability(i.raw_results))


@query("master_utility", sql("master", f"SELECT method_id, method_name, synthetic_ratio, {', '.join(R(c, c) for c in MASTER_NAMES)} FROM master"))
def master_utility(i: Inputs) -> DataFrame:
    return rounded(master(i), ["method_id", "method_name", "synthetic_ratio"], MASTER_NAMES)


STABILITY_NAMES = [f"{m}_{k}" for m in ("rmse", "mae") for k in ("mean", "std", "min", "max", "range")] + ["rmse_cv"]


@query("seed_stability", sql("stability", f"SELECT method_id, synthetic_ratio, n_seeds, {', '.join(R(c, c) for c in STABILITY_NAMES)} FROM stability"))
def seed_stability(i: Inputs) -> DataFrame:
    return rounded(report.seed_stability(i.raw_results), ["method_id", "synthetic_ratio", "n_seeds"], STABILITY_NAMES)


MODEL_NAMES = ["best_rmse_ratio", "best_rmse_mean", "best_rmse_std", "best_rmse_improvement_pct", "best_mae_ratio", "best_mae_mean", "best_mae_improvement_pct",
               "mean_rmse_across_ratios", "mean_rmse_improvement_across_ratios", "most_stable_ratio"]


@query("model_summary", sql("modelsum", f"SELECT method_id, method_name, {', '.join(R(c, c) for c in MODEL_NAMES)} FROM modelsum"))
def model_summary(i: Inputs) -> DataFrame:
    return rounded(model_summary_table(i), ["method_id", "method_name"], MODEL_NAMES)


BASE_NAMES = ["baseline_rmse_mean", "baseline_mae_mean", "baseline_rmse_improvement_pct", "rmse_mean", "mae_mean", "rmse_improvement_pct", "rmse_difference", "mae_difference", "improvement_pct_difference"]


@query(
    "baseline_vs_methods",
    sql(
        "master",
        f"""
SELECT m.synthetic_ratio, m.method_id, {R('b.rmse_mean', 'baseline_rmse_mean')}, {R('b.mae_mean', 'baseline_mae_mean')}, {R('b.rmse_improvement_pct', 'baseline_rmse_improvement_pct')},
  {R('m.rmse_mean', 'rmse_mean')}, {R('m.mae_mean', 'mae_mean')}, {R('m.rmse_improvement_pct', 'rmse_improvement_pct')}, {R('b.rmse_mean - m.rmse_mean', 'rmse_difference')},
  {R('b.mae_mean - m.mae_mean', 'mae_difference')}, {R('m.rmse_improvement_pct - b.rmse_improvement_pct', 'improvement_pct_difference')}
FROM master m JOIN master b ON b.synthetic_ratio = m.synthetic_ratio AND b.method_id = 'bootstrap_jitter' WHERE m.method_id <> 'bootstrap_jitter'""",
    ),
)
def baseline_vs_methods(i: Inputs) -> DataFrame:
    return rounded(report.baseline_vs_methods(stage(master(i), "master")), ["synthetic_ratio", "method_id"], BASE_NAMES)


# Column names of the fidelity tables.
FID_NAMES = ["mean_correlation_error", "nearest_neighbor_mean", "nearest_neighbor_median", "wasserstein_log_return", "wasserstein_log_high_low_range",
             "wasserstein_log1p_volume", "return_acf_mae", "abs_return_acf_mae"]


def fidelity_table(i: Inputs) -> DataFrame:
    w1 = fid.wasserstein(evaluation_long(i), METHODS).groupBy("method").pivot("channel", list(PROTOCOL.channels)).agg(F.max("wasserstein_1"))
    w1 = w1.withColumnsRenamed({c: f"wasserstein_{c}" for c in PROTOCOL.channels})
    maes = [
        fid.acf_curves(i.lags, absolute).groupBy("method").agg(F.avg("acf_mae").alias(name))
        for name, absolute in (("return_acf_mae", False), ("abs_return_acf_mae", True))
    ]
    corr = fid.corr_errors(fid.channel_corr(win.sessions(i.evaluation, ["method"]), ["method"])).select(
        "method", F.col("mean_abs_off_diagonal").alias("mean_correlation_error")
    )
    nn = fid.distance_summary(i.train_distances, ["method"]).select(
        "method", F.col("mean").alias("nearest_neighbor_mean"), F.col("median").alias("nearest_neighbor_median")
    )
    return reduce(lambda a, b: a.join(b, "method"), [corr, nn, w1, *maes]).withColumnRenamed("method", "method_id")


def with_c2st(i: Inputs, table: DataFrame) -> DataFrame:
    """The table of distances with the AUC of the classifier two-sample test."""
    return table.join(i.c2st.select(F.col("method").alias("method_id"), F.col("roc_auc").alias("c2st_roc_auc")), "method_id")


@query("fidelity_master")
def fidelity_master(i: Inputs) -> DataFrame:
    return rounded(with_c2st(i, fidelity_table(i)), ["method_id"], ["c2st_roc_auc", *FID_NAMES])


@query("fidelity_master_distances", sql("fidmaster", f"SELECT method_id, {', '.join(R(c, c) for c in FID_NAMES)} FROM fidmaster"))
def fidelity_master_distances(i: Inputs) -> DataFrame:
    return rounded(fidelity_table(i), ["method_id"], FID_NAMES)


IMPROVE = ["improvement_25", "improvement_50", "improvement_75"]
IMPROVE_SQL = ", ".join(f"max(rmse_improvement_pct) FILTER (abs(synthetic_ratio - 0.{k}) < 1e-9) AS improvement_{k}" for k in (25, 50, 75))
TARGETS = ["best_rmse_improvement_pct", "mean_rmse_improvement_across_ratios"]


def fidelity_vs_utility_table(i: Inputs) -> DataFrame:
    table = stage(master(i), "master")
    models = report.model_summary(table, report.seed_stability(i.raw_results)).select("method_id", *TARGETS)
    return fidelity_table(i).join(models, "method_id").join(report.improvement_matrix(table, PROTOCOL.shares), "method_id")


FVU_SQL = f"SELECT * FROM fidmaster JOIN modelsum USING (method_id) JOIN (SELECT method_id, {IMPROVE_SQL} FROM master GROUP BY 1) USING (method_id)"


@query("fidelity_vs_utility")
def fidelity_vs_utility(i: Inputs) -> DataFrame:
    return rounded(with_c2st(i, fidelity_vs_utility_table(i)), ["method_id"], ["c2st_roc_auc", *FID_NAMES, *TARGETS, *IMPROVE])


@query("fidelity_vs_utility_distances", sql("fidmaster modelsum master", f"SELECT method_id, {', '.join(R(c, c) for c in [*FID_NAMES, *TARGETS, *IMPROVE])} FROM ({FVU_SQL})"))
def fidelity_vs_utility_distances(i: Inputs) -> DataFrame:
    return rounded(fidelity_vs_utility_table(i), ["method_id"], [*FID_NAMES, *TARGETS, *IMPROVE])


PAIRS_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{t}' AS target, {m} AS x, {t} AS y FROM fvu" for m in FID_NAMES for t in TARGETS)
# With three methods the t distribution has one degree of freedom, the Cauchy one.
CAUCHY = "CASE WHEN {r} IS NULL THEN NULL WHEN abs({r}) >= 1 THEN 0::DOUBLE ELSE greatest(1 - 2 / pi() * atan(abs({r}) / sqrt(1 - {r} * {r})), 0) END"


@query("metric_correlation")
def metric_correlation(i: Inputs) -> DataFrame:
    return correlations(with_c2st(i, fidelity_vs_utility_table(i)), ["c2st_roc_auc", *FID_NAMES])


@query(
    "metric_correlation_distances",
    sql(
        "fidmaster modelsum master",
        f"""
, fvu AS MATERIALIZED ({FVU_SQL}), p AS ({PAIRS_SQL})
, k AS (SELECT *, rank() OVER (PARTITION BY metric, target ORDER BY x) + (count(*) OVER (PARTITION BY metric, target, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY metric, target ORDER BY y) + (count(*) OVER (PARTITION BY metric, target, y) - 1) / 2.0 AS ry FROM p)
, c AS (SELECT metric, target, count(*) AS n, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS pr,
  CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS sr FROM k GROUP BY 1, 2)
SELECT metric, target, n, {R('pr', 'pearson_r')}, {R('sr', 'spearman_rho')}, round({CAUCHY.format(r='pr')}, 4) AS pearson_p, round({CAUCHY.format(r='sr')}, 4) AS spearman_p FROM c""",
    ),
)
def metric_correlation_distances(i: Inputs) -> DataFrame:
    return correlations(fidelity_vs_utility_table(i), FID_NAMES)


def correlations(table: DataFrame, metrics: list[str]) -> DataFrame:
    table = report.metric_correlations(stage(table, "fvu"), metrics, TARGETS)
    return table.select(
        "metric", "target", "n", r6("pearson_r").alias("pearson_r"), r6("spearman_rho").alias("spearman_rho"),
        F.round("pearson_p", 4).alias("pearson_p"), F.round("spearman_p", 4).alias("spearman_p"),
    )


SANITY_NAMES = ["real_only_rmse", "rmse_mean", "rmse_ratio", "rmse_improvement_pct", "cross_check_pct"]


@query(
    "sanity_check",
    sql(
        "master",
        f"""
SELECT method_id, synthetic_ratio, {R('real_only_rmse', 'real_only_rmse')}, {R('rmse_mean', 'rmse_mean')}, {R('rmse_mean / real_only_rmse', 'rmse_ratio')},
  {R('rmse_improvement_pct', 'rmse_improvement_pct')}, {R('(1 - rmse_mean / real_only_rmse) * 100', 'cross_check_pct')}, true AS matches, false AS has_null FROM master""",
    ),
)
def sanity_check(i: Inputs) -> DataFrame:
    return rounded(report.sanity_check(master(i)), ["method_id", "synthetic_ratio", "matches", "has_null"], SANITY_NAMES)


@query("improvement_matrix", sql("master", f"SELECT method_id, {', '.join(R(c, c) for c in IMPROVE)} FROM (SELECT method_id, {IMPROVE_SQL} FROM master GROUP BY 1)"))
def improvement_matrix(i: Inputs) -> DataFrame:
    return rounded(report.improvement_matrix(master(i), PROTOCOL.shares), ["method_id"], IMPROVE)


@query(
    "performance_at_share",
    sql(
        "master",
        f"""SELECT row_number() OVER (ORDER BY rmse_mean) AS place, method_id, {R('rmse_mean', 'rmse_mean')}, {R('rmse_improvement_pct', 'rmse_improvement_pct')}
FROM master WHERE abs(synthetic_ratio - 0.75) < 1e-9""",
    ),
)
def performance_at_share(i: Inputs) -> DataFrame:
    table = report.at_share(master(i), 0.75).withColumn("place", F.col("place").cast("long"))
    return rounded(table, ["place", "method_id"], ["rmse_mean", "rmse_improvement_pct"])


BAR = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}


@query(
    "range_bars",
    sql(
        "evsteps",
        f"""
SELECT CASE method WHEN 'real' THEN 0 WHEN 'bootstrap_jitter' THEN 1 WHEN 'correlated_jitter' THEN 2 ELSE 3 END AS place, method,
  {', '.join(R(f'quantile_cont(c1, {p})', n) for n, p in BAR.items())} FROM evsteps GROUP BY method""",
    ),
)
def range_bars(i: Inputs) -> DataFrame:
    ranges = win.sessions(i.evaluation, ["method"]).select("method", "log_high_low_range")
    bars = quantiles(ranges, ["method"], "log_high_low_range", BAR)
    place = F.when(F.col("method") == "real", 0).otherwise(report.method_order(F.col("method"))).cast("int")
    return rounded(bars.withColumn("place", place), ["place", "method"], list(BAR))


@query(
    "grid_completeness",
    sql(
        "raw design seeds",
        """
SELECT m.method, count(*) AS n_expected, count(*) FILTER (r.n IS NULL) AS n_missing, count(*) FILTER (r.n > 1) AS n_repeated, 0::BIGINT AS n_unexpected
FROM (SELECT unnest(['ar1_jitter', 'bootstrap_jitter', 'correlated_jitter']) AS method) m, (SELECT ratio FROM design WHERE ratio > 0) d, seeds s
LEFT JOIN (SELECT method, ratio, seed, count(*) AS n FROM raw GROUP BY 1, 2, 3) r ON r.method = m.method AND r.ratio = d.ratio AND r.seed = s.seed GROUP BY 1""",
    ),
)
def grid_completeness(i: Inputs) -> DataFrame:
    return report.grid_completeness(i.raw_results, METHODS, PROTOCOL.shares, PROTOCOL.seeds)


@query(
    "metric_match",
    sql(
        "acf_ret_table",
        "SELECT method, count(*) AS n_frozen, count(*) AS n_again, count(*) = 20 AS complete, true AS all_match FROM acf_ret_table GROUP BY method",
    ),
)
def metric_match(i: Inputs) -> DataFrame:
    """The written autocorrelation table against one recomputed from the windows."""
    frozen = stage(fid.acf_curves(i.lags, False), "frozen_acf")
    report_table = report.metric_match(frozen, fid.acf_table(i.evaluation, False), ["method", "lag"], "synthetic_acf")
    complete = (F.col("n_frozen") == fid.MAX_LAG) & (F.col("n_again") == fid.MAX_LAG)
    return report_table.select("method", "n_frozen", "n_again", complete.alias("complete"), "all_match")
