"""Queries: synthetic windows by resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL
from ..functions.arrays import checksum, r6
from ..operators import candidates, resample, scaling, validity
from .inputs import POOLS, Inputs, query
from .oracle import CTE, DONORS, SUMMARY, ar_noise, norm, r6 as R, shocks, sql, unit
from .q_windows import CHECK_SQL


def check() -> Column:
    return r6(checksum(F.col("features_flat"))).alias("checksum")


@query(
    "bootstrap_windows",
    sql(
        "draws42 nwin",
        f"SELECT id AS synthetic_id, donor_idx, ticker, start_pos FROM draws42 JOIN {DONORS} d ON d.idx = donor_idx",
    ),
)
def bootstrap_windows(i: Inputs) -> DataFrame:
    draws = resample.draw_indices(i.spark, 0, i.n_donors, F.lit(i.n_donors), 42)
    return draws.join(i.donors, "donor_idx").select("synthetic_id", "donor_idx", "ticker", "start_pos")


def _pool(method: str):
    def run(i: Inputs) -> DataFrame:
        return i.pool(method).select("synthetic_id", check())

    oracle = sql("pools", f"SELECT id AS synthetic_id, {R(CHECK_SQL, 'checksum')} FROM pools WHERE method = '{method}'")
    query(method, oracle)(run)


for _method in ("bootstrap_jitter", "correlated_jitter", "ar1_jitter"):
    _pool(_method)


@query(
    "bootstrap_repro",
    sql(
        "pools3",
        """
SELECT a.method, count(*) AS n_windows, 0::BIGINT AS differ_same_seed, count(*) FILTER (a.flat <> c.flat) AS differ_other_seed
FROM (SELECT * FROM pools3 WHERE seed = 42) a JOIN (SELECT * FROM pools3 WHERE seed = 123) c USING (method, id) GROUP BY a.method""",
    ),
)
def bootstrap_repro(i: Inputs) -> DataFrame:
    again = reduce(DataFrame.unionByName, [i.pool(m, 42) for m, _, _ in POOLS])
    other = reduce(DataFrame.unionByName, [i.pool(m, 123) for m, _, _ in POOLS])
    return resample.repro_report(i.pools, again, other, ["method", "synthetic_id"])


@query(
    "window_summary",
    sql("zsumm", "SELECT idx AS donor_idx, " + ", ".join(R(c, c) for c in SUMMARY) + " FROM zsumm"),
)
def window_summary(i: Inputs) -> DataFrame:
    raw = resample.window_summary(i.donors, ["donor_idx"])
    return resample.standardized_summary(raw, ["donor_idx"]).select("donor_idx", *[r6(c).alias(c) for c in resample.SUMMARY])


@query("regime_labels", sql("regime", "SELECT idx AS donor_idx, regime::BIGINT AS regime FROM regime"))
def regime_labels(i: Inputs) -> DataFrame:
    return i.regimes.select("donor_idx", F.col("regime").cast("long").alias("regime"))


def regime_draws(i: Inputs) -> DataFrame:
    draws = resample.draw_indices(i.spark, 0, i.n_donors, F.lit(i.n_donors), 42).drop("donor_idx")
    return resample.draw_regime_members(draws, i.regimes, 42)


@query(
    "regime_bootstrap",
    sql(
        "regdraw noise42 nwin",
        f"""
SELECT id AS synthetic_id, regime::BIGINT AS regime, donor_idx, {R(CHECK_SQL, 'checksum')}
FROM (SELECT r.id, r.regime, r.donor_idx, list_transform(d.flat, lambda x, i: x + 0.05::DOUBLE * n.n[i]) AS flat
  FROM regdraw r JOIN {DONORS} d ON d.idx = r.donor_idx JOIN noise42 n ON n.id = r.id)""",
    ),
)
def regime_bootstrap(i: Inputs) -> DataFrame:
    base = resample.bootstrap(i.donors, regime_draws(i))
    noisy = resample.temporal_jitter(base, 42, 0.05, 0.85, i.donor_cholesky)
    return noisy.select("synthetic_id", F.col("regime").cast("long").alias("regime"), "donor_idx", check())


def neighbours(i: Inputs) -> DataFrame:
    points = resample.standardized_summary(i.regimes, ["donor_idx", "regime"])
    return resample.regime_neighbours(points)


@query(
    "regime_knn",
    sql("knn", f"SELECT regime::BIGINT AS regime, idx AS donor_idx, mate AS mate_idx, {R('distance', 'distance')}, rank FROM knn"),
)
def regime_knn(i: Inputs) -> DataFrame:
    return neighbours(i).select(
        F.col("regime").cast("long").alias("regime"), "donor_idx", "mate_idx", r6("distance").alias("distance"),
        F.col("rank").cast("long").alias("rank"),
    )


def mixup_base(i: Inputs) -> DataFrame:
    return resample.mixup(regime_draws(i).drop("regime"), neighbours(i), i.donors, 42)


@query(
    "regime_mixup",
    sql(
        "mix noise42",
        f"""
SELECT id AS synthetic_id, donor_idx, mate AS mate_idx, {R('w', 'weight')}, {R(CHECK_SQL, 'checksum')}
FROM (SELECT m.id, donor_idx, mate, w, list_transform(m.flat, lambda x, i: x + 0.02::DOUBLE * n.n[i]) AS flat FROM mix m JOIN noise42 n ON n.id = m.id)""",
    ),
)
def regime_mixup(i: Inputs) -> DataFrame:
    noisy = resample.temporal_jitter(mixup_base(i), 42, 0.02, 0.85, i.donor_cholesky)
    return noisy.select("synthetic_id", "donor_idx", "mate_idx", r6("weight").alias("weight"), check())


@query("pca_gmm_pool")
def pca_gmm_pool(i: Inputs) -> DataFrame:
    spec = next(s for s in candidates.GRID if s.name == "pca_gmm_24c8")
    return candidates.pca_gmm(i.donors, spec, i.n_donors, 42).select("method", "synthetic_id", check())


def jitter_candidates(i: Inputs) -> DataFrame:
    """Every candidate but the mixtures: (method, family, synthetic_id, features_flat)."""
    def specs(family: str) -> list[candidates.Candidate]:
        return [s for s in candidates.GRID if s.family == family]

    draws = resample.draw_indices(i.spark, 0, i.n_donors, F.lit(i.n_donors), 42)
    plain = resample.bootstrap(i.donors, draws).select("synthetic_id", "features_flat")
    by_regime = resample.bootstrap(i.donors, regime_draws(i)).select("synthetic_id", "features_flat")
    mixed = mixup_base(i).select("synthetic_id", "features_flat")
    chol = i.donor_cholesky
    parts = [
        candidates.jitter_family(plain, 42, specs("bootstrap_independent"), None),
        candidates.jitter_family(plain, 42, specs("bootstrap_temporal"), chol),
        candidates.jitter_family(by_regime, 42, specs("regime_bootstrap_temporal"), chol),
        candidates.jitter_family(mixed, 42, specs("regime_neighbor_mixup_temporal"), chol),
    ]
    return reduce(DataFrame.unionByName, parts)


JITTERS = [s for s in candidates.GRID if s.family != "pca_gmm"]
_BASES = {"bootstrap_independent": "plain", "bootstrap_temporal": "plain", "regime_bootstrap_temporal": "regime", "regime_neighbor_mixup_temporal": "mix"}
_VALUES = ", ".join(
    f"('{s.name}', '{s.family}', '{_BASES[s.family]}', {s.sigma}::DOUBLE, '{'z' if s.family == 'bootstrap_independent' else s.rho}')" for s in JITTERS
)
_NOISES = " UNION ALL ".join(
    f"SELECT '{rho}' AS kind, avg({CHECK_SQL}) AS x FROM (SELECT {ar_noise(rho)} AS flat FROM (SELECT {shocks(1.0)} AS e FROM draws42, chol))"
    for rho in sorted({s.rho for s in JITTERS if s.family != "bootstrap_independent"})
)


@query(
    "jitter_grid",
    # The checksum is linear: that of a pool is its base windows' plus the noise scale times the noise's.
    sql(
        "draws42 regdraw mix chol nwin",
        f"""
, base AS (SELECT 'plain' AS base, avg({CHECK_SQL}) AS c, count(*) AS n FROM draws42 JOIN {DONORS} d ON d.idx = donor_idx
  UNION ALL SELECT 'regime', avg({CHECK_SQL}), count(*) FROM regdraw JOIN {DONORS} d ON d.idx = donor_idx
  UNION ALL SELECT 'mix', avg({CHECK_SQL}), count(*) FROM mix)
, noise AS (SELECT 'z' AS kind, avg(list_sum(list_transform(z, lambda x, i: x * i)) / 195) AS x FROM draws42 UNION ALL {_NOISES})
SELECT method, family, n AS n_windows, {R("c + sigma * x", "mean_checksum")}
FROM (VALUES {_VALUES}) g(method, family, base, sigma, kind) JOIN base USING (base) JOIN noise USING (kind)""",
    ),
)
def jitter_grid(i: Inputs) -> DataFrame:
    """The 29 candidates that are drawn by hash, one row each."""
    return jitter_candidates(i).groupBy("method", "family").agg(
        F.count(F.lit(1)).alias("n_windows"), r6(F.avg(checksum(F.col("features_flat")))).alias("mean_checksum")
    )


@query("candidate_grid")
def candidate_grid(i: Inputs) -> DataFrame:
    mixtures = [
        candidates.pca_gmm(i.donors, s, i.n_donors, 42) for s in candidates.GRID if s.family == "pca_gmm"
    ]
    every = reduce(DataFrame.unionByName, [jitter_candidates(i), *mixtures])
    return every.groupBy("method", "family").agg(
        F.count(F.lit(1)).alias("n_windows"), r6(F.avg(checksum(F.col("features_flat")))).alias("mean_checksum")
    )


def name_parts(name: str) -> tuple[Column, Column]:
    """Noise scale and time correlation written in a candidate name; null when absent."""
    pattern = r"jitter_(\d+p?\d*)_rho(\d+p?\d*)"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    number = lambda c: F.regexp_replace(c, "p", ".").cast("double")
    return number(part(1)), number(part(2))


PLAIN_GRID = [s for s in candidates.GRID if s.family.startswith("bootstrap")]
GRID_SQL = ", ".join(f"('{s.name}')" for s in PLAIN_GRID)


@query(
    "parse_candidate",
    sql(
        "nwin",
        f"""
SELECT name AS method, replace(nullif(regexp_extract(name, 'jitter_(\\d+p?\\d*)_rho(\\d+p?\\d*)', 1), ''), 'p', '.')::DOUBLE AS noise_scale,
  replace(nullif(regexp_extract(name, 'jitter_(\\d+p?\\d*)_rho(\\d+p?\\d*)', 2), ''), 'p', '.')::DOUBLE AS rho, count(*) AS n_windows
FROM (VALUES {GRID_SQL}) g(name), {DONORS} GROUP BY 1, 2, 3""",
    ),
)
def parse_candidate(i: Inputs) -> DataFrame:
    draws = resample.draw_indices(i.spark, 0, i.n_donors, F.lit(i.n_donors), 42)
    plain = resample.bootstrap(i.donors, draws).select("synthetic_id", "features_flat")
    pools = [
        candidates.jitter_family(plain, 42, [s for s in PLAIN_GRID if s.family == family], chol)
        for family, chol in (("bootstrap_independent", None), ("bootstrap_temporal", i.donor_cholesky))
    ]
    noise, rho = name_parts("method")
    return reduce(DataFrame.unionByName, pools).groupBy("method", noise.alias("noise_scale"), rho.alias("rho")).agg(
        F.count(F.lit(1)).alias("n_windows")
    )


@query(
    "canonical_frame",
    sql(
        "pools",
        f"""
SELECT id AS synthetic_id, method AS source_model, 42 AS training_seed, 'global_channel_normalized' AS space, 65 AS window_length, 3 AS n_channels,
  'log_return,log_high_low_range,log1p_volume' AS channel_order, len(flat) AS n_values, {R(CHECK_SQL, 'checksum')} FROM pools""",
    ),
)
def canonical_frame(i: Inputs) -> DataFrame:
    frame = resample.canonical_frame(i.pools, F.col("method"), F.col("seed"))
    return frame.withColumn("channel_order", F.concat_ws(",", "channel_order")).select(
        *[c for c in frame.columns if c != "features_flat"], F.size("features_flat").cast("long").alias("n_values"), check()
    )


# Candidates up to five per accepted window cover every pool here.
ACCEPT = f"""
, ids AS (SELECT unnest(range(5 * (SELECT count(*) FROM {DONORS}))) AS id)
, dr AS MATERIALIZED (SELECT id, 42 AS seed, floor({unit("id || ':42:index'")} * (SELECT count(*) FROM {DONORS}))::BIGINT AS donor_idx,
  list_transform(range(195), lambda k: {norm("id || ':42:' || k")}) AS z FROM ids)
, cand AS MATERIALIZED ({CTE["pools3"][1].replace("FROM draws ", "FROM dr ")})
, okc AS (SELECT method, id, list_bool_and(list_transform(range(65), lambda t: m1 + s1 * flat[3*t+2] >= 0 AND m2 + s2 * flat[3*t+3] >= 0)) AS ok FROM cand, cal)
, acc AS (SELECT method, id, row_number() OVER (PARTITION BY method ORDER BY id) AS k FROM okc WHERE ok)
"""


@query(
    "accept_reject_pool",
    sql(
        "nwin chol cal",
        ACCEPT
        + f"""SELECT method, count(*) AS n_accepted, max(id) + 1 AS n_candidates, max(id) + 1 - count(*) AS n_rejected, sum(id)::BIGINT AS id_sum
FROM acc WHERE k <= (SELECT count(*) FROM {DONORS}) GROUP BY method""",
    ),
)
def accept_reject_pool(i: Inputs) -> DataFrame:
    """Exactly as many accepted windows per pool as there are donors, with accounting."""
    def draw(lo: int, hi: int) -> DataFrame:
        pools = reduce(DataFrame.unionByName, [i.draw(m, 42, lo, hi) for m, _, _ in POOLS])
        flat = scaling.denormalize(pools, i.calibration, out="calibrated")
        return flat.select("method", "synthetic_id", validity.is_valid(F.col("calibrated")).alias("ok"))

    accepted = validity.accept_reject(draw, ["method"], "synthetic_id", F.col("ok"), i.n_donors)
    return accepted.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_accepted"),
        F.max("candidate_no").alias("n_candidates"),
        (F.max("candidate_no") - F.count(F.lit(1))).alias("n_rejected"),
        F.sum("synthetic_id").alias("id_sum"),
    )
