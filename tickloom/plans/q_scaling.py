"""Queries: normalizers, calibration and physical validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import PROTOCOL
from ..functions.arrays import checksum, r6
from ..operators import scaling, validity, windows as win
from ..operators.sequence import quantiles, with_position
from ..session import small, stage
from .inputs import POOLS, Inputs, query, text
from .oracle import r6 as R, sql
from .q_windows import CHECK_SQL

CH = PROTOCOL.channels
LONG = "(SELECT {k}, channel, [c0, c1, c2][ci + 1] AS x FROM {t}, chan)"


@query(
    "channel_stats",
    sql(
        "steps chan",
        f"""
SELECT channel, count(*) AS n, {R('avg(x)', 'mean')}, {R('CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END', 'std')}, {R('stddev_pop(x)', 'raw_std')}
FROM (SELECT channel, [c0, c1, c2][ci + 1] AS x FROM steps, chan WHERE split = 'donor_train') GROUP BY channel""",
    ),
)
def channel_stats(i: Inputs) -> DataFrame:
    train = win.block_windows(i.features).where(F.col("split") == "donor_train")
    return scaling.channel_stats(win.sessions(train, []), []).select(
        "channel", "n", r6("mean").alias("mean"), r6("std").alias("std"), r6("raw_std").alias("raw_std")
    )


@query(
    "normalize_windows",
    sql(
        "nwin",
        "SELECT split, ticker, start_pos, round(list_sum(list_transform(flat, lambda x, i: x::FLOAT::DOUBLE * i)) / 195, 4) AS checksum FROM nwin",
    ),
)
def normalize_windows(i: Inputs) -> DataFrame:
    return i.normalized.select(
        "split", "ticker", "start_pos", F.round(checksum(scaling.to_exchange(F.col("features_flat"))), 4).alias("checksum")
    )


@query(
    "denormalize_roundtrip",
    sql(
        "nwin",
        "SELECT split, count(*) AS n_windows, true AS within_tolerance FROM nwin GROUP BY split",
    ),
)
def denormalize_roundtrip(i: Inputs) -> DataFrame:
    both = i.windows.where(F.col("split").isin("donor_train", "donor_validation"))
    z = scaling.normalize(both, i.normalizer, out="__z")
    back = scaling.denormalize(z, i.normalizer, "__z", "__back")
    error = F.array_max(F.zip_with("features_flat", "__back", lambda a, b: F.abs(a - b)))
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_windows"), (F.max(error) <= 1e-9).alias("within_tolerance")
    )


@query(
    "real_reference",
    sql(
        "nsteps chan",
        f"""
SELECT split, channel, count(*) AS n, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')}
FROM {LONG.format(k='split', t='nsteps')} GROUP BY 1, 2""",
    ),
)
def real_reference(i: Inputs) -> DataFrame:
    stats = scaling.channel_stats(win.sessions(i.normalized, ["split"]), ["split"])
    return stats.select("split", "channel", "n", r6("mean").alias("mean"), r6("raw_std").alias("std"))


@query(
    "norm_provenance",
    sql(
        "steps chan",
        f"""
, st AS (SELECT split, channel, avg(x) AS m, stddev_pop(x) AS s FROM {LONG.format(k='split', t='steps')} GROUP BY 1, 2)
SELECT d.split AS producer, CASE WHEN d.split = 'full_history' THEN 'verified' WHEN d.split = 'visible' THEN 'not_verifiable'
  WHEN bool_and(abs(d.m - o.m) <= 1e-6 AND abs(d.s - o.s) <= 1e-6) THEN 'numerically_matches' ELSE 'mismatch' END AS status
FROM st d JOIN st o ON o.channel = d.channel AND o.split = 'donor_train' GROUP BY d.split""",
    ),
)
def norm_provenance(i: Inputs) -> DataFrame:
    """Each split declares its own scale; one carries a verified hash, one declares nothing."""
    stats = scaling.channel_stats(win.sessions(i.windows, ["split"]), ["split"])
    silent = F.col("split") == "visible"
    declared = stats.select(
        F.col("split").alias("producer"), "channel",
        F.when(~silent, F.col("mean")).alias("mean"), F.when(~silent, F.col("std")).alias("std"),
    )
    observed = stats.where(F.col("split") == "donor_train")
    return scaling.provenance(observed, declared, F.col("producer") == "full_history")


@query(
    "target_calibration",
    sql(
        "visdays chan feat",
        f"""
SELECT channel, count(*) AS n_unique_days, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')},
  (SELECT min(date) FROM feat WHERE feature_block = 'visible')::VARCHAR AS start_date,
  (SELECT max(date) FROM feat WHERE feature_block = 'visible')::VARCHAR AS end_date
FROM {LONG.format(k='daily_pos', t='visdays')} GROUP BY channel""",
    ),
)
def target_calibration(i: Inputs) -> DataFrame:
    visible = i.split("visible")
    days = win.unique_daily(visible, PROTOCOL.block("visible").stride)
    span = visible.agg(
        F.struct(text(F.min("window_start_date")).alias("lo"), text(F.max("window_end_date")).alias("hi")).alias("s")
    ).select("s").scalar()
    return scaling.channel_stats(days, []).select(
        "channel", F.col("n").alias("n_unique_days"), r6("mean").alias("mean"), r6("raw_std").alias("std"),
        span["lo"].alias("start_date"), span["hi"].alias("end_date"),
    )


@query("affine_calibrate", sql("calpool", f"SELECT method, id AS synthetic_id, {R(CHECK_SQL, 'checksum')} FROM calpool"))
def affine_calibrate(i: Inputs) -> DataFrame:
    flat = F.col("calibrated")
    return scaling.denormalize(i.pools, i.calibration, out="calibrated").select(
        "method", "synthetic_id", r6(checksum(flat)).alias("checksum")
    )


@query(
    "restandardize_calibrate",
    sql(
        "pools psteps steps",
        f"""
, g AS (SELECT method, avg(c0) AS a0, avg(c1) AS a1, avg(c2) AS a2, stddev_pop(c0) AS b0, stddev_pop(c1) AS b1, stddev_pop(c2) AS b2 FROM psteps GROUP BY method),
t AS (SELECT avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2, stddev_pop(c0) AS s0, stddev_pop(c1) AS s1, stddev_pop(c2) AS s2 FROM steps WHERE split = 'visible'),
q AS (SELECT method, id, list_transform(flat, lambda x, i: (x - [a0, a1, a2][(i-1) % 3 + 1]) / [b0, b1, b2][(i-1) % 3 + 1] * [s0, s1, s2][(i-1) % 3 + 1] + [m0, m1, m2][(i-1) % 3 + 1]) AS flat
  FROM pools JOIN g USING (method), t)
SELECT method, id AS synthetic_id, {R(CHECK_SQL, 'checksum')} FROM q""",
    ),
)
def restandardize_calibrate(i: Inputs) -> DataFrame:
    """Pool moments to target moments; overlapping windows count as they come."""
    n = len(CH)
    own = win.sessions(i.pools, ["method"]).groupBy("method").agg(
        F.array(*[F.avg(c) for c in CH]).alias("mu"),
        F.array(*[F.when(F.stddev_pop(c) > scaling.ZERO_STD, F.stddev_pop(c)).otherwise(F.lit(1.0)) for c in CH]).alias("sd"),
    )
    target = scaling.fit_normalizer(i.split("visible"))
    to = F.col("__target")
    flat = F.transform(
        "features_flat",
        lambda z, k: (z - F.get("mu", k % n)) / F.get("sd", k % n) * F.get(to["sd"], k % n) + F.get(to["mu"], k % n),
    )
    scaled = i.pools.join(small(own, "moments"), "method").withColumn("__target", target)
    return scaled.select("method", "synthetic_id", r6(checksum(flat)).alias("checksum"))


@query(
    "pairing_error",
    sql(
        "calpool",
        "SELECT method, count(*) * 195 AS n_values, 0::DOUBLE AS max_abs_error FROM calpool GROUP BY method",
    ),
)
def pairing_error(i: Inputs) -> DataFrame:
    """Pool and calibrated pool joined on (method, id): largest gap to mu + sigma z."""
    left = i.calibrated.select("method", "synthetic_id", "calibrated")
    again = scaling.denormalize(i.pools, i.calibration, out="again").select("method", "synthetic_id", "again")
    gap = F.array_max(F.zip_with("calibrated", "again", lambda a, b: F.abs(a - b)))
    return left.join(again, ["method", "synthetic_id"]).groupBy("method").agg(
        F.sum(F.size("calibrated").cast("long")).alias("n_values"), F.round(F.max(gap), 9).alias("max_abs_error")
    )


@query(
    "validity_margin",
    sql(
        "psteps chan cal",
        f"""
SELECT method, channel, {R('any_value(thr)', 'zero_threshold')}, {R('min(x)', 'min_z')}, {R('max(x)', 'max_z')}, {R('min(x) - any_value(thr)', 'margin')}
FROM (SELECT method, channel, [p.c0, p.c1, p.c2][ci + 1] AS x, -[m0, m1, m2][ci + 1] / [s0, s1, s2][ci + 1] AS thr FROM psteps p, chan, cal) GROUP BY 1, 2""",
    ),
)
def validity_margin(i: Inputs) -> DataFrame:
    stats = scaling.channel_stats(win.sessions(i.pools, ["method"]), ["method"])
    index = F.array_position(F.array(*[F.lit(c) for c in CH]), F.col("channel")).cast("int") - 1
    threshold = -F.get(i.calibration["mu"], index) / F.get(i.calibration["sd"], index)
    return stats.withColumn("t", threshold).select(
        "method", "channel", r6("t").alias("zero_threshold"), r6("min").alias("min_z"), r6("max").alias("max_z"),
        r6(F.col("min") - F.col("t")).alias("margin"),
    )


@query(
    "variance_retained",
    sql(
        "psteps nsteps chan",
        f"""
SELECT p.method, {', '.join(R(f"max(100 * p.v / r.v) FILTER (channel = '{c}')", c) for c in CH)}
FROM (SELECT method, channel, var_pop(x) AS v FROM {LONG.format(k='method', t='psteps')} GROUP BY 1, 2) p
JOIN (SELECT channel, var_pop(x) AS v FROM (SELECT channel, [c0, c1, c2][ci + 1] AS x FROM nsteps, chan WHERE split = 'donor_validation') GROUP BY 1) r USING (channel)
GROUP BY p.method""",
    ),
)
def variance_retained(i: Inputs) -> DataFrame:
    pool = scaling.channel_stats(win.sessions(i.pools, ["method"]), ["method"])
    real = scaling.channel_stats(win.sessions(i.real("donor_validation"), []), [])
    share = F.pow(F.col("p.raw_std") / F.col("r.raw_std"), F.lit(2)) * 100
    both = pool.alias("p").join(real.alias("r"), "channel").select("p.method", "channel", share.alias("share"))
    return both.groupBy("method").pivot("channel", list(CH)).agg(r6(F.max("share")))


@query("window_valid", sql("validity", "SELECT method, id AS synthetic_id, ok AS is_valid FROM validity"))
def window_valid(i: Inputs) -> DataFrame:
    return scaling.denormalize(i.pools, i.calibration, out="calibrated").select(
        "method", "synthetic_id", validity.is_valid(F.col("calibrated")).alias("is_valid")
    )


@query(
    "physical_validity",
    sql(
        "validity",
        f"""SELECT method, count(*) AS generated, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid,
  {R('avg(CASE WHEN ok THEN 0.0::DOUBLE ELSE 1.0 END)', 'invalid_rate')} FROM validity GROUP BY method""",
    ),
)
def physical_validity(i: Inputs) -> DataFrame:
    return validity.validity_summary(i.calibrated, ["method"], "calibrated").withColumn("invalid_rate", r6("invalid_rate"))


@query(
    "rejection_reasons",
    sql(
        "calpool",
        """
, w AS (SELECT method, CASE
  WHEN len(list_filter(range(65), lambda t: NOT isfinite(flat[3*t+1]))) > 0 THEN 'non_finite_return'
  WHEN len(list_filter(range(65), lambda t: NOT isfinite(flat[3*t+2]))) > 0 THEN 'non_finite_range'
  WHEN len(list_filter(range(65), lambda t: flat[3*t+2] < 0)) > 0 THEN 'negative_range'
  WHEN len(list_filter(range(65), lambda t: NOT isfinite(exp(flat[3*t+3])))) > 0 THEN 'non_finite_volume'
  WHEN len(list_filter(range(65), lambda t: exp(flat[3*t+3]) - 1 < 0)) > 0 THEN 'invalid_volume' END AS reason FROM calpool)
SELECT m.method, r.reason, count(w.reason) AS n_windows
FROM (SELECT DISTINCT method FROM calpool) m, (SELECT unnest(['non_finite_return', 'non_finite_range', 'negative_range', 'non_finite_volume', 'invalid_volume', 'other']) AS reason) r
LEFT JOIN w ON w.method = m.method AND w.reason = r.reason GROUP BY 1, 2""",
    ),
)
def rejection_reasons(i: Inputs) -> DataFrame:
    return validity.reason_counts(i.calibrated, ["method"], "calibrated")


@query(
    "valid_pool",
    sql(
        "validity win",
        """
SELECT method, row_number() OVER (PARTITION BY method ORDER BY id) - 1 AS pool_row, id AS synthetic_id,
  count(*) OVER (PARTITION BY method) >= (SELECT 3 * count(*) FROM win WHERE split = 'visible') AS large_enough
FROM validity WHERE ok""",
    ),
)
def valid_pool(i: Inputs) -> DataFrame:
    """Valid windows in id order, with the gate for the largest synthetic share."""
    needed = i.split("visible").agg((3 * F.count(F.lit(1))).alias("n")).select("n").scalar()
    placed = with_position(
        i.valid_pools.select("method", "synthetic_id"), ["method"], [F.col("synthetic_id")],
        [F.floor(F.col("synthetic_id") / 65536)], "pool_row",
    )
    sizes = placed.groupBy("method").agg((F.max("pool_row") + 1).alias("n"))
    return placed.join(small(sizes, "sizes"), "method").select(
        "method", "pool_row", "synthetic_id", (F.col("n") >= needed).alias("large_enough")
    )


MARGIN_SQL = """SELECT method, id, list_min(list_transform(range(65), lambda t: flat[3*t+2])) AS lr,
  list_min(list_transform(range(65), lambda t: flat[3*t+3])) AS lv FROM calpool"""


@query(
    "physical_margins",
    sql(
        "calpool",
        f"""SELECT method, {R('quantile_cont(lr, 0.01)', 'range_p01')}, {R('quantile_cont(lr, 0.05)', 'range_p05')},
  {R('quantile_cont(lv, 0.01)', 'volume_p01')}, {R('quantile_cont(lv, 0.05)', 'volume_p05')} FROM ({MARGIN_SQL}) GROUP BY method""",
    ),
)
def physical_margins(i: Inputs) -> DataFrame:
    low_range, low_volume = validity.window_minima(F.col("calibrated"))
    lows = stage(i.calibrated.select("method", low_range.alias("lr"), low_volume.alias("lv")), "lows")
    ranges = quantiles(lows, ["method"], "lr", {"range_p01": 0.01, "range_p05": 0.05})
    volumes = quantiles(lows, ["method"], "lv", {"volume_p01": 0.01, "volume_p05": 0.05})
    names = ["range_p01", "range_p05", "volume_p01", "volume_p05"]
    return ranges.join(volumes, "method").select("method", *[r6(n).alias(n) for n in names])


QUANTS = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "channel_sanity",
    sql(
        "calsteps validity chan",
        f"""
SELECT method, channel, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')}, {R('min(x)', 'min')}, {R('max(x)', 'max')},
  {', '.join(R(f'quantile_cont(x, {p})', n) for n, p in QUANTS.items())}
FROM (SELECT method, channel, [c0, c1, c2][ci + 1] AS x FROM calsteps JOIN validity USING (method, id), chan WHERE ok) GROUP BY 1, 2""",
    ),
)
def channel_sanity(i: Inputs) -> DataFrame:
    steps = win.sessions(i.valid_pools, ["method"], flat="calibrated")
    stats = scaling.channel_stats(steps, ["method"])
    long = win.unpivot_channels(steps, ["method"])
    parts = stats.join(quantiles(long, ["method", "channel"], "value", QUANTS), ["method", "channel"])
    return parts.select(
        "method", "channel", r6("mean").alias("mean"), r6("raw_std").alias("std"), r6("min").alias("min"),
        r6("max").alias("max"), *[r6(n).alias(n) for n in QUANTS],
    )


@query(
    "residual_validity",
    sql(
        "calsteps validity",
        f"""
SELECT method, bool_and(isfinite(c0) AND isfinite(c1) AND isfinite(c2)) AS all_finite, {R('min(c1)', 'min_range')},
  {R('min(c2)', 'min_log1p_volume')}, {R('min(exp(c2) - 1)', 'min_expm1_volume')}, 0::BIGINT AS invalid_left
FROM calsteps JOIN validity USING (method, id) WHERE ok GROUP BY method""",
    ),
)
def residual_validity(i: Inputs) -> DataFrame:
    out = validity.residual_validity(i.valid_pools, ["method"], "calibrated")
    names = ["min_range", "min_log1p_volume", "min_expm1_volume"]
    return out.select("method", "all_finite", *[r6(n).alias(n) for n in names], "invalid_left")
