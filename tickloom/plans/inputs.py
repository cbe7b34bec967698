"""The chain of tables that the registered queries start from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import PROTOCOL
from ..functions.arrays import channel
from ..operators import classify, features, fidelity, resample, scaling, splits, utility, validity, windows
from ..session import path_exists, shared_dir, ship_package, stage
from ..sources import panel as panel_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with its SQL twin where SQL can express it."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(inputs_for(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


_shared: dict[tuple, "Inputs"] = {}


def inputs_for(spark: SparkSession, sf_dir: str) -> "Inputs":
    """The chain of one application over one state of the source files.

    Queries of a run share the staged tables, so a pool or a window table is built once
    and each metric is its own job over it. New or changed source files, or a cleared
    stage folder, start a new chain.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(f"{sf_dir}/lineitem.parquet")
    state = files.agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))
    ).first()
    key = (spark.sparkContext.applicationId, sf_dir, tuple(state))
    if key not in _shared or not path_exists(spark, f"{shared_dir(spark)}/stages"):
        _shared[key] = Inputs(spark, sf_dir)
    return _shared[key]


def forget() -> None:
    """Start every following query from the source files again."""
    _shared.clear()


def text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def row_hash() -> Column:
    """First 8 hex digits of md5(ticker:date) as a number."""
    digest = F.md5(F.concat(F.col("ticker"), F.lit(":"), F.col("date").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def make_dirty(panel: DataFrame) -> DataFrame:
    """The panel with float edges, material errors, null closes and zero volumes."""
    h = row_hash()
    return panel.withColumn("__h", h).select(
        "date",
        "ticker",
        "open",
        F.when(F.col("__h") % 79 == 0, F.col("close") - F.lit(1e-11))
        .when(F.col("__h") % 97 == 0, F.col("low") * F.lit(0.99))
        .otherwise(F.col("high"))
        .alias("high"),
        "low",
        F.when(F.col("__h") % 89 == 0, F.lit(None)).otherwise(F.col("close")).alias("close"),
        F.when(F.col("__h") % 83 == 0, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
    )


# The pools every comparison query uses: (method, noise scale, time correlation).
POOLS = (("ar1_jitter", 0.10, 0.85), ("bootstrap_jitter", 0.05, None), ("correlated_jitter", 0.10, 0.0))


class Inputs:
    """Tables of one query run. What is read more than once is staged."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.proto = PROTOCOL

    def table(self, name: str) -> DataFrame:
        return panel_source.table(self.spark, self.sf_dir, name)

    @cached_property
    def panel(self) -> DataFrame:
        return stage(panel_source.trades_to_panel(self.table("lineitem")), "panel")

    @cached_property
    def dirty(self) -> DataFrame:
        return stage(make_dirty(panel_source.trades_to_panel(self.table("lineitem"))), "dirty")

    @cached_property
    def features(self) -> DataFrame:
        return stage(features.daily_features(splits.feature_blocks(self.panel)), "features")

    @cached_property
    def windows(self) -> DataFrame:
        return stage(windows.block_windows(self.features), "windows")

    def split(self, name: str) -> DataFrame:
        return self.windows.where(F.col("split") == name)

    @cached_property
    def test_windows(self) -> DataFrame:
        return windows.test_index(self.features)

    @cached_property
    def normalizer(self) -> Column:
        return scaling.fit_normalizer(self.split("donor_train"))

    @cached_property
    def normalized(self) -> DataFrame:
        """Donor windows of both splits on the scale fitted on donor_train."""
        both = self.windows.where(F.col("split").isin("donor_train", "donor_validation"))
        return stage(scaling.normalize(both, self.normalizer).drop("dates"), "normalized")

    def real(self, name: str) -> DataFrame:
        return self.normalized.where(F.col("split") == name)

    @cached_property
    def donors(self) -> DataFrame:
        return stage(resample.donor_rows(self.real("donor_train")), "donors")

    @cached_property
    def n_donors(self) -> int:
        return self.donors.count()

    @cached_property
    def donor_cholesky(self) -> Column:
        return resample.correlation_row(self.donors)

    @cached_property
    def regimes(self) -> DataFrame:
        """Donors with raw summary numbers and regime."""
        raw = stage(resample.window_summary(self.donors, ["donor_idx"]), "summary")
        return stage(resample.regime_labels(raw), "regimes")

    def draw(self, method: str, seed: int, lo: int, hi: int) -> DataFrame:
        """Synthetic windows with ids in [lo, hi) of one pool."""
        sigma, rho = next((s, r) for m, s, r in POOLS if m == method)
        drawn = resample.bootstrap(
            self.donors, resample.draw_indices(self.spark, lo, hi, F.lit(self.n_donors), seed)
        )
        if rho is None:
            out = resample.jitter(drawn, seed, sigma)
        else:
            out = resample.temporal_jitter(drawn, seed, sigma, rho, self.donor_cholesky)
        return out.select(F.lit(method).alias("method"), F.lit(seed).alias("seed"), "synthetic_id", "features_flat")

    def pool(self, method: str, seed: int = 42) -> DataFrame:
        """As many synthetic windows as there are donors."""
        return self.draw(method, seed, 0, self.n_donors)

    def union_pools(self, seeds: tuple[int, ...] = (42,)) -> DataFrame:
        out = None
        for method, _, _ in POOLS:
            for seed in seeds:
                one = self.pool(method, seed)
                out = one if out is None else out.unionByName(one)
        return out

    @cached_property
    def pools(self) -> DataFrame:
        """The three seed-42 pools: (method, seed, synthetic_id, features_flat)."""
        return stage(self.union_pools(), "pools")

    @cached_property
    def subset(self) -> DataFrame:
        """Ids of the shared evaluation subset: as many as there are validation windows."""
        n_real = self.real("donor_validation").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
        ids = self.spark.range(self.n_donors).withColumnRenamed("id", "synthetic_id")
        return stage(fidelity.common_subset(ids, "synthetic_id", n_real, 42), "subset")

    @cached_property
    def real_rows(self) -> DataFrame:
        """Validation windows as (method="real", window_id, features_flat)."""
        return windows.with_window_index(self.real("donor_validation"), []).select(
            F.lit("real").alias("method"), F.col("window_idx").alias("window_id"), "features_flat"
        )

    @cached_property
    def evaluation(self) -> DataFrame:
        """Real validation windows and the shared subset of each pool."""
        picked = fidelity.apply_subset(self.pools, self.subset, "synthetic_id").select(
            "method", F.col("synthetic_id").alias("window_id"), "features_flat"
        )
        return stage(self.real_rows.unionByName(picked), "evaluation")

    @cached_property
    def train_distances(self) -> DataFrame:
        """Distance of every evaluation window to its nearest donor."""
        return stage(fidelity.nearest_train(self.evaluation, self.donors), "distances")

    @cached_property
    def lags(self) -> DataFrame:
        """Autocorrelations of every channel and of absolute returns of the evaluation windows, from one pass."""
        series = {c: channel(F.col("features_flat"), k) for k, c in enumerate(self.proto.channels)}
        table = fidelity.lag_table(self.evaluation, ["method"], series | fidelity.return_series(), list(range(1, fidelity.MAX_LAG + 1)))
        return stage(table, "lags")

    def pairs(self, folds: int) -> DataFrame:
        """Validation windows beside the shared subset of each pool, in stratified folds."""
        rows = self.evaluation.withColumnRenamed("window_id", "row_id")
        real = F.col("method") == "real"
        pairs = classify.labelled_pairs(rows.where(real), rows.where(~real), "method", [m for m, _, _ in POOLS])
        return stage(classify.with_folds(pairs, "method", folds), "pairs")

    @cached_property
    def c2st_scores(self) -> DataFrame:
        """Out-of-fold probabilities of the classifier two-sample test."""
        return classify.out_of_fold_scores(self.pairs(5), "method", [m for m, _, _ in POOLS])

    @cached_property
    def c2st(self) -> DataFrame:
        """AUC and accuracy of the classifier two-sample test, one row per method."""
        return stage(fidelity.roc_auc(self.c2st_scores, ["method"]), "c2st")

    @cached_property
    def scores(self) -> DataFrame:
        """(method, label, score) of real (0) and synthetic (1) windows per method.

        The score is 1 / (1 + distance to the nearest donor): copies score high.
        """
        methods = F.array(*[F.lit(m) for m, _, _ in POOLS])
        score = 1.0 / (1.0 + F.col("distance"))
        real = self.train_distances.where(F.col("method") == "real").select(
            F.explode(methods).alias("method"), F.lit(0).alias("label"), score.alias("score")
        )
        synthetic = self.train_distances.where(F.col("method") != "real").select(
            "method", F.lit(1).alias("label"), score.alias("score")
        )
        return stage(real.unionByName(synthetic), "scores")

    @cached_property
    def calibration(self) -> Column:
        """Target scale from the unique days of the visible windows."""
        days = windows.unique_daily(self.split("visible"), PROTOCOL.block("visible").stride)
        return scaling.scaler_row(days).select("scaler").scalar()

    @cached_property
    def calibrated(self) -> DataFrame:
        """Pools on the target scale, with both arrays."""
        return stage(scaling.denormalize(self.pools, self.calibration, out="calibrated"), "calibrated")

    @cached_property
    def valid_pools(self) -> DataFrame:
        return self.calibrated.where(validity.is_valid(F.col("calibrated")))

    @cached_property
    def real_features(self) -> DataFrame:
        """Volatility features of the visible target windows."""
        return stage(utility.vol_features(self.split("visible"), []), "real_features")

    @cached_property
    def n_real(self) -> Column:
        return self.real_features.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()

    @cached_property
    def synthetic_features(self) -> DataFrame:
        """Volatility features of every valid calibrated window."""
        return stage(utility.vol_features(self.valid_pools, ["method", "synthetic_id"], "calibrated"), "synthetic_features")

    @cached_property
    def test_features(self) -> DataFrame:
        return stage(utility.vol_features(self.test_windows, ["test_row"]), "test_features")

    @cached_property
    def mixtures(self) -> DataFrame:
        return utility.mixture_rows(self.synthetic_features, self.n_real, [m for m, _, _ in POOLS])

    @cached_property
    def models(self) -> DataFrame:
        """One ridge per training set, all scaled by the real windows."""
        sets = utility.training_sets(self.real_features, self.mixtures, [m for m, _, _ in POOLS])
        stats = utility.moments(sets, ["method", "ratio", "seed"])
        return stage(utility.solve_ridge(stats, ["method", "ratio", "seed"], utility.scale_row(self.real_features)), "models")

    @cached_property
    def raw_results(self) -> DataFrame:
        """(method, ratio, seed, rmse, mae), with one real-only row."""
        return stage(utility.score_models(self.models, self.test_features, ["method", "ratio", "seed"]), "raw")

    @cached_property
    def comparison(self) -> DataFrame:
        """One row per candidate of the grid."""
        from .q_utility import comparison_table

        return comparison_table(self)

    @cached_property
    def summary(self) -> DataFrame:
        return utility.downstream_summary(self.raw_results)
