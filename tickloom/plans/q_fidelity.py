"""Queries: real against synthetic windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import PROTOCOL
from ..functions.arrays import checksum, r6
from ..operators import features, fidelity as fid, windows as win
from ..operators.classify import require_equal_classes
from ..operators.sequence import quantiles
from .inputs import POOLS, Inputs, query, text
from .oracle import DONORS, VALID, acf, r6 as R, sql
from .q_windows import CHECK_SQL

CH = PROTOCOL.channels
METHODS = [m for m, _, _ in POOLS]


def rounded(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(n).alias(n) for n in names])


@query(
    "common_subset",
    sql("subset", "SELECT id AS synthetic_id FROM subset"),
)
def common_subset(i: Inputs) -> DataFrame:
    return i.subset


@query("apply_subset", sql("pools subset", f"SELECT method, id AS synthetic_id, {R(CHECK_SQL, 'checksum')} FROM pools WHERE id IN (SELECT id FROM subset)"))
def apply_subset(i: Inputs) -> DataFrame:
    picked = fid.apply_subset(i.pools, i.subset, "synthetic_id")
    return picked.select("method", "synthetic_id", r6(checksum(F.col("features_flat"))).alias("checksum"))


@query(
    "balanced_sample",
    sql(
        "pools nwin",
        f"""
SELECT method, window_id FROM (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY md5(window_id || ':42:order'), window_id) AS k, count(*) OVER (PARTITION BY method) AS n
  FROM (SELECT method, id AS window_id FROM pools UNION ALL SELECT 'real', idx FROM {VALID}))
QUALIFY k <= min(n) OVER ()""",
    ),
)
def balanced_sample(i: Inputs) -> DataFrame:
    pools = i.pools.select("method", F.col("synthetic_id").alias("window_id"))
    both = i.real_rows.select("method", "window_id").unionByName(pools)
    return fid.balanced_sample(both, "method", "window_id", 42)


PCT = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
PCT_SQL = ", ".join(R(f"quantile_cont(x, {p})", n) for n, p in PCT.items())


@query(
    "marginal_stats",
    sql(
        "evlong",
        f"""SELECT method, channel, count(*) AS n, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')}, {PCT_SQL},
  {R('skewness(x)', 'skewness')}, {R('kurtosis(x)', 'excess_kurtosis')} FROM evlong GROUP BY 1, 2""",
    ),
)
def marginal_stats(i: Inputs) -> DataFrame:
    stats = fid.marginal_stats(win.sessions(i.evaluation, ["method"]), ["method"], bias=False)
    return rounded(stats, ["method", "channel", "n"], ["mean", "std", *PCT, "skewness", "excess_kurtosis"])


@query(
    "channel_statistics",
    sql(
        "evlong",
        f"""
SELECT method, channel, count(*) AS n, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')}, {R('min(x)', 'min')}, {R('max(x)', 'max')}, {PCT_SQL},
  {R('avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5)', 'skewness')}, {R('kurtosis_pop(x)', 'excess_kurtosis')}
FROM (SELECT *, avg(x) OVER (PARTITION BY method, channel) AS m FROM evlong) GROUP BY 1, 2""",
    ),
)
def channel_statistics(i: Inputs) -> DataFrame:
    stats = fid.marginal_stats(win.sessions(i.evaluation, ["method"]), ["method"], bias=True)
    return rounded(stats, ["method", "channel", "n"], ["mean", "std", "min", "max", *PCT, "skewness", "excess_kurtosis"])


@query(
    "channel_summary",
    sql("evlong", f"SELECT method, channel, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')}, {R('min(x)', 'min')}, {R('max(x)', 'max')} FROM evlong GROUP BY 1, 2"),
)
def channel_summary(i: Inputs) -> DataFrame:
    from ..operators.scaling import channel_stats

    stats = channel_stats(win.sessions(i.evaluation, ["method"]), ["method"]).drop("std").withColumnRenamed("raw_std", "std")
    return rounded(stats, ["method", "channel"], ["mean", "std", "min", "max"])


def evaluation_long(i: Inputs) -> DataFrame:
    return win.unpivot_channels(win.sessions(i.evaluation, ["method"]), ["method"])


@query(
    "wasserstein",
    sql("w1", f"SELECT method, channel, {R('w', 'wasserstein_1')}, {R('avg(w) OVER (PARTITION BY method)', 'mean_wasserstein')} FROM w1"),
)
def wasserstein(i: Inputs) -> DataFrame:
    table = fid.wasserstein(evaluation_long(i), METHODS)
    means = table.groupBy("method").agg(F.avg("wasserstein_1").alias("mean_wasserstein"))
    return rounded(table.join(means, "method"), ["method", "channel"], ["wasserstein_1", "mean_wasserstein"])


ACF_NAMES = ["real_acf", "synthetic_acf", "difference", "absolute_difference", "acf_mae"]
ACF_SQL = f"""SELECT method, lag, {R('real_acf', 'real_acf')}, {R('synthetic_acf', 'synthetic_acf')}, {R('difference', 'difference')},
  {R('gap', 'absolute_difference')}, {R('acf_mae', 'acf_mae')}, real_valid AS real_valid_windows, synthetic_valid AS synthetic_valid_windows FROM """


def _acf_query(name: str, table: str, absolute: bool) -> None:
    def run(i: Inputs) -> DataFrame:
        keep = ["method", F.col("lag").cast("long").alias("lag"), "real_valid_windows", "synthetic_valid_windows"]
        return rounded(fid.acf_curves(i.lags, absolute), keep, ACF_NAMES)

    query(name, sql(table, ACF_SQL + table))(run)


_acf_query("return_acf", "acf_ret_table", False)
_acf_query("abs_return_acf", "acf_abs_table", True)


@query(
    "acf_gap_summary",
    sql(
        "acf_ret_table acf_abs_table",
        f"""
SELECT kind, method, {R('avg(gap)', 'mean_gap')}, {R('max(gap)', 'max_gap')}, arg_max(lag, gap) AS lag_of_max
FROM (SELECT 'return' AS kind, * FROM acf_ret_table UNION ALL SELECT 'abs_return', * FROM acf_abs_table) GROUP BY 1, 2""",
    ),
)
def acf_gap_summary(i: Inputs) -> DataFrame:
    parts = [
        fid.acf_gaps(fid.acf_curves(i.lags, absolute)).withColumn("kind", F.lit(kind))
        for kind, absolute in (("return", False), ("abs_return", True))
    ]
    both = reduce(DataFrame.unionByName, parts)
    return rounded(both, ["kind", "method", F.col("lag_of_max").cast("long").alias("lag_of_max")], ["mean_gap", "max_gap"])


@query(
    "autocorr_multilag",
    sql(
        "evlong chan",
        f"""
SELECT method, channel, lag, {R('avg(acf)', 'autocorr_mean')}, {R('stddev_pop(acf)', 'autocorr_std')}, count(acf) AS valid_windows
FROM ({acf('evlong', 'x', 5)}) JOIN chan USING (ci) GROUP BY 1, 2, 3""",
    ),
)
def autocorr_multilag(i: Inputs) -> DataFrame:
    table = i.lags.where(F.col("channel").isin(*CH) & (F.col("lag") <= 5)).select("method", "channel", "lag", "acf", "acf_std", "valid_windows")
    named = table.withColumnsRenamed({"acf": "autocorr_mean", "acf_std": "autocorr_std"})
    keep = ["method", "channel", F.col("lag").cast("long").alias("lag"), "valid_windows"]
    return rounded(named, keep, ["autocorr_mean", "autocorr_std"])


@query(
    "autocorr_pearson",
    sql(
        "evlong",
        f"""
SELECT method, lag, {R('avg(r)', 'autocorr')}, count(r) AS n_windows FROM (
  SELECT a.method, a.window_id, k AS lag, CASE WHEN stddev_pop(a.x) > 1e-8 AND stddev_pop(b.x) > 1e-8 THEN corr(a.x, b.x) END AS r
  FROM evlong a, (SELECT unnest(range(1, 11)) AS k), evlong b
  WHERE a.ci = 0 AND b.ci = 0 AND a.method = b.method AND a.window_id = b.window_id AND b.t = a.t + k GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ),
)
def autocorr_pearson(i: Inputs) -> DataFrame:
    table = i.lags.where((F.col("channel") == CH[0]) & (F.col("lag") <= 10))
    return table.select("method", F.col("lag").cast("long").alias("lag"), r6("pearson").alias("autocorr"), F.col("pearson_windows").alias("n_windows"))


CORR_SQL = f"""SELECT method, a.channel AS row_channel, b.channel AS column_channel, {R('v', 'correlation')}
FROM corrm JOIN chan a ON a.ci = r JOIN chan b ON b.ci = c"""


@query("channel_corr", sql("corrm chan", CORR_SQL))
def channel_corr(i: Inputs) -> DataFrame:
    table = fid.channel_corr(win.sessions(i.evaluation, ["method"]), ["method"])
    return rounded(table, ["method", "row_channel", "column_channel"], ["correlation"])


@query(
    "channel_corr_error",
    sql("correrr", f"SELECT method, {R('mean_gap', 'mean_abs_off_diagonal')}, {R('max_gap', 'max_abs_off_diagonal')} FROM correrr"),
)
def channel_corr_error(i: Inputs) -> DataFrame:
    table = fid.channel_corr(win.sessions(i.evaluation, ["method"]), ["method"])
    return rounded(fid.corr_errors(table), ["method"], ["mean_abs_off_diagonal", "max_abs_off_diagonal"])


@query("nn_distance", sql("nn", f"SELECT method, window_id, {R('distance', 'distance')} FROM nn"))
def nn_distance(i: Inputs) -> DataFrame:
    return rounded(fid.nearest_train(i.evaluation, i.donors), ["method", "window_id"], ["distance"])


SUM_NAMES = ["mean", "median", "std", "min", "p01", "p05", "p95", "max"]


def summary_sql(x: str) -> str:
    return f"""count(*) AS n, {R(f'avg({x})', 'mean')}, {R(f'median({x})', 'median')}, {R(f'stddev_pop({x})', 'std')}, {R(f'min({x})', 'min')},
  {R(f'quantile_cont({x}, 0.01)', 'p01')}, {R(f'quantile_cont({x}, 0.05)', 'p05')}, {R(f'quantile_cont({x}, 0.95)', 'p95')}, {R(f'max({x})', 'max')}"""


@query("nn_summary", sql("nn", f"SELECT method, {summary_sql('distance')} FROM nn GROUP BY method"))
def nn_summary(i: Inputs) -> DataFrame:
    return rounded(fid.distance_summary(i.train_distances, ["method"]), ["method", "n"], SUM_NAMES)


@query(
    "memorization",
    sql(
        "ev nwin",
        f"""
SELECT method, count(*) AS n, count(*) FILTER (d = 0) AS exact_copies, count(*) FILTER (d <= 1e-6) AS near_copies
FROM (SELECT method, window_id, min(list_distance(e.flat, d.flat)) AS d
  FROM (SELECT * FROM ev UNION ALL SELECT 'train', idx, flat FROM {DONORS}) e, {DONORS} d GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def memorization(i: Inputs) -> DataFrame:
    """The donors themselves join in as a method whose windows are all copies."""
    train = i.donors.select(F.lit("train").alias("method"), F.col("donor_idx").alias("window_id"), "features_flat")
    return fid.memorization(fid.nearest_train(i.evaluation.unionByName(train), i.donors))


COPIES = f"(SELECT method, id, flat FROM pools UNION ALL SELECT 'bootstrap', id, d.flat FROM draws42 JOIN {DONORS} d ON d.idx = donor_idx)"


def pools_with_plain(i: Inputs) -> DataFrame:
    """The pools plus the plain bootstrap, whose windows repeat."""
    from ..operators import resample

    draws = resample.draw_indices(i.spark, 0, i.n_donors, F.lit(i.n_donors), 42)
    plain = resample.bootstrap(i.donors, draws).select(F.lit("bootstrap").alias("method"), "synthetic_id", "features_flat")
    return i.pools.select("method", "synthetic_id", "features_flat").unionByName(plain)


@query(
    "diversity",
    sql(
        "pools draws42 nwin",
        f"""
, w AS (SELECT method, flat, [stddev_pop(flat[3*t+1]), stddev_pop(flat[3*t+2]), stddev_pop(flat[3*t+3])] AS s FROM {COPIES}, (SELECT unnest(range(65)) AS t) GROUP BY method, id, flat)
SELECT method, n_windows, n_unique, n_windows - n_unique AS duplicates, collapsed_log_return, collapsed_log_high_low_range, collapsed_log1p_volume, collapsed_any,
  {', '.join(R(f'v{k}', f'variance_{c}') for k, c in enumerate(CH))}
FROM (SELECT method, count(*) AS n_windows, count(DISTINCT flat) AS n_unique, {', '.join(f'count(*) FILTER (s[{k + 1}] <= 1e-8) AS collapsed_{c}' for k, c in enumerate(CH))},
  count(*) FILTER (list_min(s) <= 1e-8) AS collapsed_any FROM w GROUP BY method)
JOIN (SELECT method, {', '.join(f'var_pop(flat[3*t+{k + 1}]) AS v{k}' for k in range(3))} FROM {COPIES}, (SELECT unnest(range(65)) AS t) GROUP BY method) USING (method)""",
    ),
)
def diversity(i: Inputs) -> DataFrame:
    table = fid.diversity(pools_with_plain(i), ["method"])
    keep = ["method", "n_windows", "n_unique", "duplicates", *[f"collapsed_{c}" for c in CH], "collapsed_any"]
    return rounded(table, keep, [f"variance_{c}" for c in CH])


@query(
    "pairwise_distance",
    sql(
        "pools",
        f"""
SELECT method, {summary_sql('d').replace('count(*) AS n', 'count(*) AS n_pairs')} FROM (
  SELECT a.method, list_distance(a.flat, b.flat) AS d FROM pools a JOIN pools b ON a.method = b.method AND a.id < b.id) GROUP BY method""",
    ),
)
def pairwise_distance(i: Inputs) -> DataFrame:
    return rounded(fid.pairwise_distances(i.pools, "method", "synthetic_id"), ["method", "n_pairs"], SUM_NAMES)


def mmd_rows(i: Inputs, pools: DataFrame, key: str) -> DataFrame:
    """All validation windows beside all windows of each pool."""
    names = [r[0] for r in pools.select(key).distinct().collect()]  # the few pool names
    real = i.real_rows.select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias(key), F.lit(True).alias("is_real"), F.col("window_id").alias("synthetic_id"), "features_flat"
    )
    return real.unionByName(pools.select(key, F.lit(False).alias("is_real"), "synthetic_id", "features_flat"))


@query("mmd_rbf", sql("mmd", f"SELECT method, n::BIGINT AS n_real, m::BIGINT AS n_synthetic, {R('gamma', 'gamma')}, {R('mmd', 'mmd')} FROM mmd"))
def mmd_rbf(i: Inputs) -> DataFrame:
    return rounded(fid.mmd_rbf(mmd_rows(i, i.pools, "method"), "method", "synthetic_id"), ["method", "n_real", "n_synthetic"], ["gamma", "mmd"])


@query("roc_auc", sql("auc scores", f"""
SELECT method, count(*) AS n, {R('any_value(roc_auc)', 'roc_auc')}, {R('avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1::DOUBLE ELSE 0 END)', 'accuracy')}
FROM scores JOIN auc USING (method) GROUP BY method"""))
def roc_auc(i: Inputs) -> DataFrame:
    return rounded(fid.roc_auc(i.scores, ["method"]), ["method", "n"], ["roc_auc", "accuracy"])


@query(
    "roc_curve",
    sql(
        "scores",
        f"""
SELECT method, {R('s', 'threshold')}, {R('fp / n0', 'fpr')}, {R('tp / n1', 'tpr')} FROM (
  SELECT method, score AS s, sum(sum((label = 0)::INT)) OVER o AS fp, sum(sum((label = 1)::INT)) OVER o AS tp,
    (sum(sum((label = 0)::INT)) OVER (PARTITION BY method))::DOUBLE AS n0, (sum(sum((label = 1)::INT)) OVER (PARTITION BY method))::DOUBLE AS n1
  FROM scores GROUP BY method, score WINDOW o AS (PARTITION BY method ORDER BY score DESC))""",
    ),
)
def roc_curve(i: Inputs) -> DataFrame:
    return rounded(fid.roc_curve(i.scores, ["method"]), ["method"], ["threshold", "fpr", "tpr"])


@query(
    "confusion_matrix",
    sql(
        "scores",
        """
SELECT m.method, g.label, g.predicted, count(s.label) AS n
FROM (SELECT DISTINCT method FROM scores) m, (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(label, predicted)) g
LEFT JOIN scores s ON s.method = m.method AND s.label = g.label AND (s.score >= 0.5)::INT = g.predicted GROUP BY 1, 2, 3""",
    ),
)
def confusion_matrix(i: Inputs) -> DataFrame:
    return fid.confusion(i.scores, ["method"])


@query("quality_verdict")
def quality_verdict(i: Inputs) -> DataFrame:
    """Verdict of the classifier two-sample test; the MMD beside it has a twin of its own."""
    auc = i.c2st
    best = auc.agg(F.min_by("method", F.struct(F.abs(F.col("roc_auc") - 0.5), "method")).alias("m")).select("m").scalar()
    both = auc.join(fid.mmd_rbf(mmd_rows(i, i.pools, "method"), "method", "synthetic_id"), "method")
    return both.withColumn("closest", F.col("method") == best).select(
        "method", r6("roc_auc").alias("c2st_roc_auc"), r6("mmd").alias("mmd"), fid.verdict(F.col("roc_auc")).alias("verdict"), "closest"
    )


@query(
    "embedding_input",
    sql(
        "ev",
        f"""
SELECT row_number() OVER (ORDER BY method, window_id) - 1 AS row_id, method, CASE WHEN method = 'real' THEN 0 ELSE 1 END AS label, window_id,
  len(flat) AS n_values, {R(CHECK_SQL, 'checksum')} FROM ev""",
    ),
)
def embedding_input(i: Inputs) -> DataFrame:
    from ..operators.sequence import with_position

    require_equal_classes(i.evaluation, "method")
    placed = with_position(
        i.evaluation, [], [F.col("method"), F.col("window_id")], [F.col("method"), F.floor(F.col("window_id") / 65536)], "row_id"
    )
    return placed.select(
        "row_id", "method", (F.col("method") != "real").cast("int").alias("label"), "window_id",
        F.size("features_flat").cast("long").alias("n_values"), r6(checksum(F.col("features_flat"))).alias("checksum"),
    )


@query(
    "histogram_density",
    sql(
        "evlong",
        f"""
, e AS (SELECT channel, CASE WHEN min(x) = max(x) THEN min(x) - 0.5::DOUBLE ELSE min(x) END AS lo,
    CASE WHEN min(x) = max(x) THEN 1.0::DOUBLE ELSE max(x) - min(x) END / 60.0::DOUBLE AS w FROM evlong GROUP BY channel)
, c AS (SELECT method, channel, least(floor((x - lo) / w), 59)::BIGINT AS bin, count(*) AS n FROM evlong JOIN e USING (channel) GROUP BY 1, 2, 3)
SELECT m.method, e.channel, b.bin, {R('lo + b.bin * w', 'left_edge')}, coalesce(c.n, 0) AS n, {R('coalesce(c.n, 0) / (m.total * w)', 'density')}
FROM (SELECT method, channel, count(*) AS total FROM evlong GROUP BY 1, 2) m JOIN e USING (channel), (SELECT unnest(range(60)) AS bin) b
LEFT JOIN c ON c.method = m.method AND c.channel = e.channel AND c.bin = b.bin""",
    ),
)
def histogram_density(i: Inputs) -> DataFrame:
    return rounded(fid.histogram(evaluation_long(i), ["method"], 60), ["method", "channel", "bin", "n"], ["left_edge", "density"])


@query(
    "time_profile",
    sql("evlong", f"SELECT method, t, channel, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')} FROM evlong GROUP BY 1, 2, 3"),
)
def time_profile(i: Inputs) -> DataFrame:
    long = win.window_long(i.evaluation, ["method"])
    return long.groupBy("method", F.col("t").cast("long").alias("t"), "channel").agg(
        r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std")
    )


BANDS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


@query(
    "quantile_bands",
    sql("evlong", f"SELECT method, t, channel, {', '.join(R(f'quantile_cont(x, {p})', n) for n, p in BANDS.items())} FROM evlong GROUP BY 1, 2, 3"),
)
def quantile_bands(i: Inputs) -> DataFrame:
    long = win.window_long(i.evaluation, ["method"]).withColumn("t", F.col("t").cast("long"))
    return rounded(quantiles(long, ["method", "t", "channel"], "value", BANDS), ["method", "t", "channel"], list(BANDS))


SCORECARD_SQL = """
SELECT w.method, w.mean_w AS mean_wasserstein, r.acf_mae AS return_acf_mae, b.acf_mae AS abs_return_acf_mae, c.mean_gap AS corr_mae, n.nn_mean, n.nn_median
FROM (SELECT method, avg(w) AS mean_w FROM w1 GROUP BY 1) w
JOIN (SELECT method, any_value(acf_mae) AS acf_mae FROM acf_ret_table GROUP BY 1) r USING (method)
JOIN (SELECT method, any_value(acf_mae) AS acf_mae FROM acf_abs_table GROUP BY 1) b USING (method)
JOIN correrr c USING (method) JOIN (SELECT method, avg(distance) AS nn_mean, median(distance) AS nn_median FROM nn GROUP BY 1) n USING (method)"""
SCORE_NAMES = ["mean_wasserstein", "return_acf_mae", "abs_return_acf_mae", "corr_mae", "nn_mean", "nn_median"]


def scorecard(i: Inputs) -> DataFrame:
    """One row per method; each metric stays on its own."""
    steps = win.sessions(i.evaluation, ["method"])
    w1 = fid.wasserstein(evaluation_long(i), METHODS).groupBy("method").agg(F.avg("wasserstein_1").alias("mean_wasserstein"))
    maes = [
        fid.acf_curves(i.lags, absolute).groupBy("method").agg(F.first("acf_mae").alias(name))
        for name, absolute in (("return_acf_mae", False), ("abs_return_acf_mae", True))
    ]
    corr = fid.corr_errors(fid.channel_corr(steps, ["method"])).select("method", F.col("mean_abs_off_diagonal").alias("corr_mae"))
    nn = fid.distance_summary(i.train_distances, ["method"]).select("method", F.col("mean").alias("nn_mean"), F.col("median").alias("nn_median"))
    return reduce(lambda a, b: a.join(b, "method"), [w1, *maes, corr, nn])


@query("scorecard_distances", sql("w1 acf_ret_table acf_abs_table correrr nn", f"SELECT method, {', '.join(R(c, c) for c in SCORE_NAMES)} FROM ({SCORECARD_SQL})"))
def scorecard_distances(i: Inputs) -> DataFrame:
    return rounded(scorecard(i), ["method"], SCORE_NAMES)


@query("fidelity_scorecard")
def fidelity_scorecard(i: Inputs) -> DataFrame:
    """``scorecard_distances`` with the AUC of the classifier two-sample test."""
    table = scorecard(i).join(i.c2st.select("method", F.col("roc_auc").alias("c2st_roc_auc")), "method")
    return rounded(table, ["method"], ["c2st_roc_auc", *SCORE_NAMES])


@query(
    "annual_shift",
    sql(
        "feat",
        f"""
SELECT y AS year, {R('s', 'return_std')}, {R('m', 'range_mean')}, y = arg_max(y, s) OVER () AS most_volatile FROM (
  SELECT year(date) AS y, stddev_samp(log_return) AS s, avg(log_high_low_range) AS m FROM feat
  WHERE feature_block IN ('donor_train', 'donor_validation') GROUP BY 1)""",
    ),
)
def annual_shift(i: Inputs) -> DataFrame:
    donors = i.features.where(F.col("feature_block").isin("donor_train", "donor_validation"))
    yearly = donors.groupBy(F.year("date").cast("long").alias("year")).agg(
        F.stddev_samp("log_return").alias("return_std"), F.avg("log_high_low_range").alias("range_mean")
    )
    top = yearly.agg(F.max_by("year", "return_std").alias("y")).select("y").scalar()
    return yearly.withColumn("most_volatile", F.col("year") == top).select(
        "year", r6("return_std").alias("return_std"), r6("range_mean").alias("range_mean"), "most_volatile"
    )


@query(
    "nn_distance_rows",
    sql(
        "nn",
        f"""SELECT CASE WHEN method = 'real' THEN 'real_validation' ELSE method END AS source,
  row_number() OVER (PARTITION BY method ORDER BY window_id) - 1 AS query_index, {R('distance', 'nearest_distance')} FROM nn""",
    ),
)
def nn_distance_rows(i: Inputs) -> DataFrame:
    from ..operators.sequence import with_position

    placed = with_position(
        i.train_distances, ["method"], [F.col("window_id")], [F.floor(F.col("window_id") / 65536)], "query_index"
    )
    source = F.when(F.col("method") == "real", "real_validation").otherwise(F.col("method"))
    return placed.select(source.alias("source"), "query_index", r6("distance").alias("nearest_distance"))


@query(
    "trajectory_sample",
    sql(
        "pools nwin",
        f"""
SELECT method, window_id, t, {R('flat[3*t+1]', 'log_return')} FROM (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY md5(window_id || ':42:order'), window_id) AS k
  FROM (SELECT method, id AS window_id, flat FROM pools UNION ALL SELECT 'real', idx, flat FROM {VALID})), (SELECT unnest(range(65)) AS t) WHERE k <= 8""",
    ),
)
def trajectory_sample(i: Inputs) -> DataFrame:
    pools = i.pools.select("method", F.col("synthetic_id").alias("window_id"), "features_flat")
    picked = fid.bounded_sample(i.real_rows.unionByName(pools), ["method"], "window_id", 42, 8)
    return win.sessions(picked, ["method", "window_id"]).select(
        "method", "window_id", F.col("t").cast("long").alias("t"), r6("log_return").alias("log_return")
    )
