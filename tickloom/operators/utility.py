"""Volatility features, real/synthetic mixtures and ridge scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from ..functions.arrays import absolute, channel, mean, std_pop, tail, total
from .draw import first_rows

FEATURES = ("rv5", "rv20", "rv60", "mean_abs_return20", "momentum20", "mean_range20", "mean_log_volume20", "std_log_volume20")
TRADING_DAYS = 252.0
REAL_ONLY = "REAL_ONLY"
ALPHA = 1.0


def realized_vol(returns: Column, k: int) -> Column:
    """Annualized root mean square of the last ``k`` returns."""
    return F.sqrt(F.lit(TRADING_DAYS / k) * total(F.transform(tail(returns, k), lambda x: x * x)))


def vol_features(df: DataFrame, keep: list[str], flat: str = "features_flat", proto: Protocol = PROTOCOL) -> DataFrame:
    """Eight numbers from the context days and the realized volatility of the horizon."""
    n = proto.context
    cut = df.select(
        *keep,
        F.slice(channel(F.col(flat), 0), 1, n).alias("r"),
        F.slice(channel(F.col(flat), 0), n + 1, proto.horizon).alias("future"),
        F.slice(channel(F.col(flat), 1), n - 19, 20).alias("h"),
        F.slice(channel(F.col(flat), 2), n - 19, 20).alias("v"),
    )
    r, h, v = F.col("r"), F.col("h"), F.col("v")
    cols = (
        realized_vol(r, 5),
        realized_vol(r, 20),
        realized_vol(r, 60),
        mean(absolute(tail(r, 20))),
        total(tail(r, 20)),
        mean(h),
        mean(v),
        std_pop(v),
    )
    return cut.select(
        *keep, *[c.alias(name) for name, c in zip(FEATURES, cols)], realized_vol(F.col("future"), proto.horizon).alias("y")
    )


def synthetic_count(n_real: Column, share: Column) -> Column:
    """Synthetic rows that make up ``share`` of the mixture, halves to even."""
    return F.bround(n_real * share / (1.0 - share)).cast("long")


def mixture_design(n_real: Column, spark, proto: Protocol = PROTOCOL) -> DataFrame:
    """One row per share, the real-only design included."""
    shares = spark.range(1).select(F.explode(F.array(*[F.lit(float(s)) for s in (0.0, *proto.shares)])).alias("ratio"))
    return shares.withColumn("n_real", n_real).withColumn("n_synthetic", synthetic_count(F.col("n_real"), F.col("ratio")))


def require_pool_sizes(pool: DataFrame, n_real: Column, methods: list[str], proto: Protocol = PROTOCOL) -> None:
    """Raise when a method has too few valid windows for its largest mixture."""
    names = pool.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    sizes = pool.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    short = (
        names.join(sizes, "method", "left")
        .select("method", F.coalesce("n", F.lit(0)).alias("n"), n_real.alias("__real"))
        .withColumn("need", synthetic_count(F.col("__real"), F.lit(max(proto.shares))))
        .where(F.col("n") < F.col("need"))
        .collect()  # one row per method at most
    )
    if short:
        raise ValueError("too few valid windows: " + ", ".join(f"{r.method} {r.n} < {r.need}" for r in short))


def mixture_rows(pool: DataFrame, n_real: Column, methods: list[str], proto: Protocol = PROTOCOL) -> DataFrame:
    """Synthetic rows of every (method, ratio, seed) mixture, without replacement.

    ``pool`` holds (method, synthetic_id, ...) of valid windows. Each seed orders a
    pool by hash and every share takes the first rows of that order. A pool that is too
    small, or absent, is an error.
    """
    require_pool_sizes(pool, n_real, methods, proto)
    seeds = F.array(*[F.lit(s) for s in proto.seeds])
    seeded = pool.withColumn("seed", F.explode(seeds)).withColumn("__n_real", n_real)
    sizes = [(float(s), synthetic_count(F.col("__n_real"), F.lit(float(s)))) for s in proto.shares]
    drawn = first_rows(seeded, ["method", "seed"], "synthetic_id", F.col("seed"), F.array(*[n for _, n in sizes]))
    # Shares of one size take the same rows.
    grid = F.array(*[F.struct(F.lit(share).alias("ratio"), n.alias("n")) for share, n in sizes])
    spread = drawn.withColumn("__g", F.explode(grid)).where(F.col("__g.n") == F.col("__n"))
    return spread.withColumn("ratio", F.col("__g.ratio")).drop("__g", "__n", "__n_real")


def training_sets(real: DataFrame, mixtures: DataFrame, methods: list[str], proto: Protocol = PROTOCOL) -> DataFrame:
    """Rows of all training sets: (method, ratio, seed, features, y).

    The real rows join every set; the sets are a grid of parameters.
    """
    cell = lambda m, r, s: F.struct(F.lit(m).alias("method"), F.lit(r).alias("ratio"), F.lit(s).cast("int").alias("seed"))
    cells = [cell(REAL_ONLY, 0.0, None)] + [cell(m, float(r), s) for m in methods for r in proto.shares for s in proto.seeds]
    spread = real.select(F.explode(F.array(*cells)).alias("__c"), *FEATURES, "y").select("__c.*", *FEATURES, "y")
    return spread.unionByName(mixtures.select("method", "ratio", F.col("seed").cast("int").alias("seed"), *FEATURES, "y"))


def scaler(rows: DataFrame) -> DataFrame:
    """Mean and population std per feature in long form; a zero std scales by one."""
    one = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in FEATURES])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in FEATURES])
    long = one.select(F.explode(cells).alias("__c")).select("__c.*")
    return long.withColumn("std", F.when(F.col("std") == 0.0, 1.0).otherwise(F.col("std")))


def scale_row(rows: DataFrame) -> Column:
    """Feature scales of the given rows as one scalar array."""
    sds = [F.stddev_pop(c) for c in FEATURES]
    return rows.agg(F.array(*[F.when(s == 0.0, 1.0).otherwise(s) for s in sds]).alias("s")).select("s").scalar()


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row count, means and the centred cross products of each training set.

    All models of a grid come from one aggregation that combines on the map side; what
    is left per model is a few dozen numbers.
    """
    names = [*FEATURES, "y"]
    n = F.count(F.lit(1))
    cross = [F.covar_pop(a, b) * n for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"), F.array(*cross).alias("cross")
    )


def solve_ridge(stats: DataFrame, keys: list[str], scale: Column | None, alpha: float = ALPHA) -> DataFrame:
    """Ridge coefficients per training set, with a free intercept.

    ``scale`` holds the feature scales the penalty applies to; without it each set is
    scaled by its own spread. Returns ``coef`` on scaled features, ``weights`` on raw
    ones and ``intercept`` for raw features.
    """
    p = len(FEATURES)
    prepared = stats.withColumn("__scale", scale if scale is not None else F.lit(None).cast("array<double>"))
    fields = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, n long, coef array<double>, weights array<double>, intercept double"

    def solve(batches):
        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            coef, weights, intercept = [], [], []
            for n, means, cross, s in zip(*[cols[c].to_pylist() for c in ("n", "means", "cross", "__scale")]):
                full = np.zeros((p + 1, p + 1))
                full[np.triu_indices(p + 1)] = cross
                spread = np.sqrt(np.diag(full)[:p] / n) if s is None else np.array(s)
                spread = np.where(spread == 0.0, 1.0, spread)
                gram = full[:p, :p] + np.triu(full[:p, :p], 1).T
                w = np.linalg.solve(gram / np.outer(spread, spread) + alpha * np.eye(p), full[:p, p] / spread)
                coef.append(w.tolist())
                weights.append((w / spread).tolist())
                intercept.append(float(means[p] - (w / spread) @ np.array(means[:p])))
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*[cols[k] for k in keys], cols["n"], pa.array(coef, lists), pa.array(weights, lists), pa.array(intercept, pa.float64())],
                [*keys, "n", "coef", "weights", "intercept"],
            )

    return prepared.select(*keys, "n", "means", "cross", "__scale").mapInArrow(solve, schema)


def score_models(models: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE and MAE of each model on the untouched test windows.

    The models are a parameter grid of a few numbers each; they ride along as one
    scalar array, so the test windows are read once and never joined row by row.
    """
    packed = models.agg(F.collect_list(F.struct(*keys, "weights", "intercept")).alias("m")).select("m").scalar()
    rows = test.select(F.array(*FEATURES).alias("x"), "y").withColumn("__m", packed)
    each = rows.select("x", "y", F.explode("__m").alias("m"))
    product = total(F.zip_with("x", F.col("m.weights"), lambda a, b: a * b))
    errors = each.select(*[F.col(f"m.{k}").alias(k) for k in keys], (F.col("m.intercept") + product - F.col("y")).alias("e"))
    return errors.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae")
    )


def downstream_summary(raw: DataFrame) -> DataFrame:
    """Mean and population std over seeds, with gaps to the real-only row."""
    real = raw.where(F.col("method") == REAL_ONLY).agg(
        F.struct(F.max("rmse").alias("rmse"), F.max("mae").alias("mae"), F.count(F.lit(1)).alias("n")).alias("r")
    ).select("r").scalar()
    grouped = raw.groupBy("method", "ratio").agg(
        F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"),
        F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"),
    ).withColumn("__r", real)
    out = grouped
    for name in ("rmse", "mae"):
        gap = F.col(f"mean_{name}") - F.col("__r")[name]
        out = out.withColumn(f"delta_{name}", gap).withColumn(f"delta_{name}_pct", gap / F.col("__r")[name] * 100.0)
    return out.drop("__r")


def interpretation(summary: DataFrame, validity: DataFrame) -> DataFrame:
    """Best observed share per method, with its invalid rate."""
    picked = ["ratio", "mean_rmse", "delta_rmse_pct", "mean_mae", "delta_mae_pct"]
    best = summary.where(F.col("ratio") > 0).groupBy("method").agg(
        F.min_by(F.struct(*picked), F.struct("mean_rmse", "ratio")).alias("b")
    )
    return best.join(validity.select("method", "invalid_rate"), "method").select("method", "b.*", "invalid_rate")


def coef_table(models: DataFrame) -> DataFrame:
    """Coefficients in long form, one row per model and feature."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.get("coef", F.lit(k)).alias("coefficient")) for k, c in enumerate(FEATURES)])
    return models.select("method", F.explode(cells).alias("__c")).select("method", "__c.*")


def coef_cosine(models: DataFrame, base: str) -> DataFrame:
    """Cosine similarity of each model's coefficients to the base model's."""
    ref = models.where(F.col("method") == base).select("coef").limit(1).scalar()
    both = models.where(F.col("method") != base).withColumn("__ref", ref)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    cosine = dot("coef", "__ref") / F.sqrt(dot("coef", "coef") * dot("__ref", "__ref"))
    return both.select("method", cosine.alias("cosine"))
