"""Report tables from result tables. Their size is set by the method grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .utility import REAL_ONLY

METHOD_ORDER = ("bootstrap_jitter", "correlated_jitter", "ar1_jitter")
METHOD_NAMES = {
    "bootstrap_jitter": "Bootstrap + jitter",
    "correlated_jitter": "Correlated jitter",
    "ar1_jitter": "AR(1) jitter",
}


def method_name(col: Column) -> Column:
    name = col
    for key, label in METHOD_NAMES.items():
        name = F.when(col == key, label).otherwise(name)
    return name


def method_order(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHOD_ORDER]), col)


def real_only(summary: DataFrame) -> Column:
    """The single real-only row as a scalar struct; any other count stops the job."""
    rows = summary.where(F.col("method") == REAL_ONLY)
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.max("mean_rmse").alias("rmse"), F.max("mean_mae").alias("mae"))
    checked = F.when(F.col("n") == 1, F.struct("rmse", "mae")).otherwise(
        F.raise_error(F.lit("expected exactly one real-only row")).cast("struct<rmse:double,mae:double>")
    )
    return one.select(checked.alias("r")).scalar()


def master_utility(summary: DataFrame) -> DataFrame:
    rows = summary.where(F.col("method") != REAL_ONLY).withColumn("__r", real_only(summary))
    out = rows.select(
        F.col("method").alias("method_id"),
        method_name(F.col("method")).alias("method_name"),
        F.col("ratio").alias("synthetic_ratio"),
        F.col("mean_rmse").alias("rmse_mean"),
        F.col("std_rmse").alias("rmse_std"),
        F.col("mean_mae").alias("mae_mean"),
        F.col("std_mae").alias("mae_std"),
        F.col("__r.rmse").alias("real_only_rmse"),
        F.col("__r.mae").alias("real_only_mae"),
    )
    for m in ("rmse", "mae"):
        gain = F.col(f"real_only_{m}") - F.col(f"{m}_mean")
        out = out.withColumn(f"{m}_improvement_abs", gain).withColumn(
            f"{m}_improvement_pct", gain / F.col(f"real_only_{m}") * 100.0
        )
    return out.orderBy(method_order(F.col("method_id")), "synthetic_ratio")


def seed_stability(raw: DataFrame) -> DataFrame:
    rows = raw.where(F.col("method") != REAL_ONLY)
    stats = []
    for m in ("rmse", "mae"):
        stats += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"), (F.max(m) - F.min(m)).alias(f"{m}_range"),
        ]
    grouped = rows.groupBy(F.col("method").alias("method_id"), F.col("ratio").alias("synthetic_ratio"))
    return grouped.agg(*stats, (F.stddev_pop("rmse") / F.avg("rmse")).alias("rmse_cv"), F.count("seed").alias("n_seeds"))


def model_summary(master: DataFrame, stability: DataFrame) -> DataFrame:
    ratio = F.col("synthetic_ratio")
    best = master.groupBy("method_id", "method_name").agg(
        F.min_by(F.struct(ratio.alias("best_rmse_ratio"), F.col("rmse_mean").alias("best_rmse_mean"), F.col("rmse_std").alias("best_rmse_std"),
                          F.col("rmse_improvement_pct").alias("best_rmse_improvement_pct")), F.struct("rmse_mean", ratio)).alias("a"),
        F.min_by(F.struct(ratio.alias("best_mae_ratio"), F.col("mae_mean").alias("best_mae_mean"),
                          F.col("mae_improvement_pct").alias("best_mae_improvement_pct")), F.struct("mae_mean", ratio)).alias("b"),
        F.avg("rmse_mean").alias("mean_rmse_across_ratios"),
        F.avg("rmse_improvement_pct").alias("mean_rmse_improvement_across_ratios"),
    )
    steady = stability.groupBy("method_id").agg(
        F.min_by("synthetic_ratio", F.struct("rmse_std", "synthetic_ratio")).alias("most_stable_ratio")
    )
    return best.join(steady, "method_id").select(
        "method_id", "method_name", "a.*", "b.*", "mean_rmse_across_ratios", "mean_rmse_improvement_across_ratios", "most_stable_ratio"
    )


def baseline_vs_methods(master: DataFrame, baseline: str = METHOD_ORDER[0]) -> DataFrame:
    cols = ["rmse_mean", "mae_mean", "rmse_improvement_pct"]
    base = master.where(F.col("method_id") == baseline).select(
        "synthetic_ratio", *[F.col(c).alias(f"baseline_{c}") for c in cols]
    )
    both = master.where(F.col("method_id") != baseline).join(base, "synthetic_ratio")
    return both.select(
        "synthetic_ratio", "method_id", *[f"baseline_{c}" for c in cols], *cols,
        (F.col("baseline_rmse_mean") - F.col("rmse_mean")).alias("rmse_difference"),
        (F.col("baseline_mae_mean") - F.col("mae_mean")).alias("mae_difference"),
        (F.col("rmse_improvement_pct") - F.col("baseline_rmse_improvement_pct")).alias("improvement_pct_difference"),
    )


def improvement_matrix(master: DataFrame, shares: tuple[float, ...], key: str = "method_id") -> DataFrame:
    """Method by share, one column per share."""
    return master.groupBy(key).agg(
        *[
            F.max(F.when(F.abs(F.col("synthetic_ratio") - s) < 1e-9, F.col("rmse_improvement_pct"))).alias(f"improvement_{round(s * 100)}")
            for s in shares
        ]
    )


def at_share(master: DataFrame, share: float) -> DataFrame:
    """Methods at one share, best first. The table has one row per method."""
    ranked = master.where(F.abs(F.col("synthetic_ratio") - share) < 1e-9)
    place = F.row_number().over(W.partitionBy("synthetic_ratio").orderBy("rmse_mean"))
    return ranked.select(place.alias("place"), "method_id", "rmse_mean", "rmse_improvement_pct")


def sanity_check(master: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Improvement recomputed as one minus the error ratio."""
    ratio = F.col("rmse_mean") / F.col("real_only_rmse")
    out = master.withColumn("rmse_ratio", ratio).withColumn("cross_check_pct", (1.0 - F.col("rmse_ratio")) * 100.0)
    same = F.abs(F.col("cross_check_pct") - F.col("rmse_improvement_pct")) <= tol + 1e-5 * F.abs(F.col("rmse_improvement_pct"))
    missing = F.lit(False)
    for c in master.columns:
        missing = missing | F.col(c).isNull()
    return out.select(
        "method_id", "synthetic_ratio", "real_only_rmse", "rmse_mean", "rmse_ratio", "rmse_improvement_pct",
        "cross_check_pct", same.alias("matches"), missing.alias("has_null"),
    )


def with_two_sided_p(df: DataFrame, r: str, n: str, name: str) -> DataFrame:
    """Add the two-sided p value of correlation ``r`` over ``n`` pairs.

    Uses the finite series of the t distribution for whole degrees of freedom n - 2.
    Each term is the one before times cos^2 j / (j + 1), for j up to df - 3.
    """
    dof = F.col(n) - 2
    open_r = F.abs(r) < 1.0
    t = F.when(open_r & (dof > 0), F.abs(r) * F.sqrt(dof / (1.0 - F.col(r) * F.col(r))))
    angled = df.withColumn("__theta", F.atan(t / F.sqrt(dof.cast("double"))))
    angled = angled.withColumns({"__sin": F.sin("__theta"), "__cos": F.cos("__theta")})
    is_odd = dof % 2 == 1
    start = F.when(is_odd, 2).otherwise(1)
    steps = F.when(dof - 3 >= start, F.sequence(start, (dof - 3).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))
    first = F.when(is_odd, F.col("__cos")).otherwise(F.lit(1.0))
    angled = angled.withColumns({"__steps": steps, "__first": first, "__cos2": F.col("__cos") * F.col("__cos")})
    terms = F.aggregate(
        "__steps",
        F.array("__first"),
        lambda acc, j: F.array_append(acc, F.element_at(acc, -1) * F.col("__cos2") * j / (j + 1)),
    )
    angled = angled.withColumn("__sum", F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))
    odd = F.lit(2.0 / math.pi) * (F.col("__theta") + F.when(dof > 1, F.col("__sin") * F.col("__sum")).otherwise(0.0))
    inside = F.when(is_odd, odd).otherwise(F.col("__sin") * F.col("__sum"))
    p = F.when(F.col(r).isNull() | (dof < 1), F.lit(None)).when(~open_r, 0.0).otherwise(F.greatest(1.0 - inside, F.lit(0.0)))
    return angled.withColumn(name, p).select(*df.columns, name)


def _corr(x: str, y: str) -> Column:
    """Pearson correlation; null when a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def metric_correlations(table: DataFrame, metrics: list[str], targets: list[str]) -> DataFrame:
    """Pearson and Spearman of every metric with every target over the methods."""
    def long(names: list[str], key: str, value: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])
        return table.select("method_id", F.explode(cells).alias("__c")).select("method_id", "__c.*")

    def ranked(df: DataFrame, key: str, value: str) -> DataFrame:
        # Average rank of ties: the lowest rank plus half the number of other ties.
        low = F.rank().over(W.partitionBy(key).orderBy(value))
        ties = F.count(F.lit(1)).over(W.partitionBy(key, value))
        return df.withColumn(f"rank_{value}", low + (ties - 1) / 2.0)

    pairs = ranked(long(metrics, "metric", "x"), "metric", "x").join(ranked(long(targets, "target", "y"), "target", "y"), "method_id")
    stats = pairs.groupBy("metric", "target").agg(
        F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("pearson_r"), _corr("rank_x", "rank_y").alias("spearman_rho")
    )
    stats = with_two_sided_p(stats, "pearson_r", "n", "pearson_p")
    return with_two_sided_p(stats, "spearman_rho", "n", "spearman_p")


def grid_completeness(raw: DataFrame, methods: list[str], shares: tuple[float, ...], seeds: tuple[int, ...]) -> DataFrame:
    """Missing, repeated and unexpected (ratio, seed) cells per method."""
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(r)).alias("ratio"), F.lit(s).alias("seed")) for m in methods for r in shares for s in seeds])
    grid = raw.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*", F.lit(1).alias("wanted"))
    seen = raw.where(F.col("method") != REAL_ONLY).groupBy("method", "ratio", "seed").agg(F.count(F.lit(1)).alias("n"))
    both = grid.join(seen, ["method", "ratio", "seed"], "full_outer")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return both.groupBy("method").agg(
        F.count("wanted").alias("n_expected"),
        n(F.col("n").isNull()).alias("n_missing"),
        n(F.col("n") > 1).alias("n_repeated"),
        n(F.col("wanted").isNull()).alias("n_unexpected"),
    )


def metric_match(frozen: DataFrame, again: DataFrame, keys: list[str], value: str, tol: float = 5e-12) -> DataFrame:
    """Two result tables on the same keys: complete, and equal within ``tol``."""
    a = frozen.select(*keys, F.col(value).alias("a"))
    b = again.select(*keys, F.col(value).alias("b"))
    both = a.join(b, keys, "full_outer")
    close = F.coalesce(F.abs(F.col("a") - F.col("b")) <= tol, F.lit(False))
    return both.groupBy(keys[0]).agg(
        F.count("a").alias("n_frozen"), F.count("b").alias("n_again"), F.bool_and(close).alias("all_match")
    )
