"""The same steps as DuckDB SQL: named fragments joined into WITH queries."""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: str, sql: str) -> None:
    CTE[name] = (tuple(deps.split()), sql)


def sql(deps: str, body: str) -> str:
    """``body`` with every fragment it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in deps.split():
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTE[n][1].strip()}\n)" for n in order)
    body = body.strip()
    return f"WITH RECURSIVE {parts}\n{body}" if parts else body


def r6(expr: str, name: str = "") -> str:
    """Round to six decimals, with no negative zero."""
    rounded = f"round(({expr})::DOUBLE, 6)"
    alias = f" AS {name}" if name else ""
    return f"CASE WHEN {rounded} = 0 THEN 0::DOUBLE ELSE {rounded} END{alias}"


def unit(text: str, start: int = 1) -> str:
    """Uniform draw from a word of md5(text)."""
    return f"((('0x' || substr(md5({text}), {start}, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)"


def norm(text: str) -> str:
    """Standard normal draw from md5(text)."""
    return f"(sqrt(-2.0::DOUBLE * ln({unit(text, 1)})) * cos(6.283185307179586::DOUBLE * {unit(text, 9)}))"


cte(
    "panel",
    "",
    """
SELECT CAST(l_shipdate AS DATE) AS date, 'T' || (l_suppkey % 5) AS ticker,
  first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS open,
  max(p) AS high, min(p) AS low,
  last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS close,
  sum(l_quantity) AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem)
GROUP BY 1, 2
""",
)
cte(
    "dirty",
    "panel",
    """
SELECT date, ticker, open,
  CASE WHEN h % 79 = 0 THEN close - 1e-11::DOUBLE WHEN h % 97 = 0 THEN low * 0.99::DOUBLE ELSE high END AS high,
  low,
  CASE WHEN h % 89 = 0 THEN NULL ELSE close END AS close,
  CASE WHEN h % 83 = 0 THEN 0::DOUBLE ELSE volume END AS volume
FROM (SELECT *, ('0x' || substr(md5(ticker || ':' || CAST(date AS VARCHAR)), 1, 8))::BIGINT AS h FROM panel)
""",
)
FULL = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL"
TOL = "(1e-10::DOUBLE + 1e-12::DOUBLE * greatest(abs(open), abs(high), abs(low), abs(close)))"


def ok(tol: str = TOL) -> str:
    return (
        f"(high + {tol} >= low AND high + {tol} >= open AND high + {tol} >= close "
        f"AND low - {tol} <= open AND low - {tol} <= close AND volume >= 0)"
    )


cte("valid", "dirty", f"SELECT * FROM dirty WHERE {FULL} AND {ok()}")
cte(
    "cover",
    "valid",
    """
SELECT ticker, count(DISTINCT date) AS n_dates, (SELECT count(DISTINCT date) FROM valid) AS calendar_dates,
  count(DISTINCT date)::DOUBLE / (SELECT count(DISTINCT date) FROM valid) AS coverage
FROM valid GROUP BY ticker
""",
)
cte("cleaned", "valid cover", "SELECT v.* FROM valid v JOIN cover c USING (ticker) WHERE c.coverage >= 0.96")
cte(
    "blocks",
    "",
    """
SELECT * FROM (VALUES
  ('donor_train', false, DATE '1995-01-01', DATE '1999-12-31', 5),
  ('donor_validation', false, DATE '2000-01-01', DATE '2000-12-31', 5),
  ('visible', true, DATE '2000-07-01', DATE '2000-12-31', 1),
  ('full_history', true, DATE '1995-01-01', DATE '2000-12-31', 1),
  ('test_source', true, DATE '2000-07-01', DATE '2001-11-04', 1)
) b(feature_block, is_target, lo, hi, stride)
""",
)
cte(
    "splits",
    "",
    """
SELECT * FROM (VALUES
  (0, 'donor_train', false, DATE '1995-01-01', DATE '1999-12-31'),
  (1, 'donor_validation', false, DATE '2000-01-01', DATE '2000-12-31'),
  (2, 'hidden', true, DATE '1995-01-01', DATE '2000-06-30'),
  (3, 'visible', true, DATE '2000-07-01', DATE '2000-12-31'),
  (4, 'test', true, DATE '2001-01-01', DATE '2001-11-04')
) s(label_order, split, is_target, lo, hi)
""",
)
cte(
    "blocked",
    "panel blocks",
    "SELECT b.feature_block, p.* FROM panel p JOIN blocks b ON (p.ticker = 'T0') = b.is_target AND p.date BETWEEN b.lo AND b.hi",
)
cte(
    "labelled",
    "panel splits",
    """
SELECT p.*, coalesce(s.split, 'unused') AS split
FROM panel p LEFT JOIN splits s ON (p.ticker = 'T0') = s.is_target AND p.date BETWEEN s.lo AND s.hi
""",
)
cte(
    "feat",
    "blocked",
    """
SELECT * FROM (
  SELECT feature_block, date, ticker,
    ln(close / lag(close) OVER (PARTITION BY feature_block, ticker ORDER BY date)) AS log_return,
    ln(high / low) AS log_high_low_range, ln(1 + volume) AS log1p_volume
  FROM blocked)
WHERE log_return IS NOT NULL AND isfinite(log_return) AND isfinite(log_high_low_range) AND isfinite(log1p_volume)
""",
)
cte(
    "cut",
    "feat",
    """
SELECT * FROM (
  SELECT feature_block AS split, ticker, row_number() OVER o - 1 AS start_pos, date AS window_start_date,
    list(date) OVER f AS dates,
    list([log_return, log_high_low_range, log1p_volume]) OVER f AS rows_
  FROM feat
  WINDOW o AS (PARTITION BY feature_block, ticker ORDER BY date),
         f AS (PARTITION BY feature_block, ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 64 FOLLOWING))
WHERE len(dates) = 65
""",
)
cte(
    "win",
    "cut blocks",
    """
SELECT c.split, c.ticker, c.start_pos, c.window_start_date, c.dates[65] AS window_end_date,
  flatten(c.rows_) AS flat, c.dates
FROM cut c JOIN blocks b ON b.feature_block = c.split
WHERE c.split <> 'test_source' AND c.start_pos % b.stride = 0
""",
)
cte(
    "testwin",
    "cut",
    """
SELECT row_number() OVER (ORDER BY start_pos) - 1 AS test_row, * EXCLUDE (v)
FROM (
  SELECT ticker, start_pos, window_start_date, dates[65] AS window_end_date, flatten(rows_) AS flat,
    dates[1:60] AS context_dates, dates[61:65] AS target_dates,
    row_number() OVER (ORDER BY start_pos) - 1 AS v
  FROM cut
  WHERE split = 'test_source' AND dates[61] >= DATE '2001-01-01' AND dates[65] <= DATE '2001-11-04')
WHERE v % 5 = 0
""",
)
cte("chan", "", "SELECT * FROM (VALUES (0, 'log_return'), (1, 'log_high_low_range'), (2, 'log1p_volume')) c(ci, channel)")
cte(
    "steps",
    "win",
    """
SELECT split, ticker, start_pos, t, flat[3*t+1] AS c0, flat[3*t+2] AS c1, flat[3*t+3] AS c2
FROM win, (SELECT unnest(range(65)) AS t)
""",
)
cte(
    "norm",
    "steps",
    """
SELECT avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2,
  stddev_pop(c0) AS s0, stddev_pop(c1) AS s1, stddev_pop(c2) AS s2
FROM steps WHERE split = 'donor_train'
""",
)
# Normalized donor windows in long form, one row per (split, window, t).
cte(
    "nsteps",
    "steps norm",
    """
SELECT split, ticker, start_pos, t, (c0 - m0) / s0 AS c0, (c1 - m1) / s1 AS c1, (c2 - m2) / s2 AS c2
FROM steps, norm WHERE split IN ('donor_train', 'donor_validation')
""",
)
cte(
    "nwin",
    "win norm",
    """
SELECT split, ticker, start_pos,
  row_number() OVER (PARTITION BY split ORDER BY ticker, start_pos) - 1 AS idx,
  list_transform(flat, lambda x, i: (x - [m0, m1, m2][(i - 1) % 3 + 1]) / [s0, s1, s2][(i - 1) % 3 + 1]) AS flat
FROM win, norm WHERE split IN ('donor_train', 'donor_validation')
""",
)
cte("visdays", "steps", "SELECT DISTINCT start_pos + t AS daily_pos, c0, c1, c2 FROM steps WHERE split = 'visible'")
cte(
    "cal",
    "visdays",
    """
SELECT count(*) AS n, avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2,
  stddev_pop(c0) AS s0, stddev_pop(c1) AS s1, stddev_pop(c2) AS s2 FROM visdays
""",
)

# Pools: as many synthetic windows as donors, ids 0..n-1.
DONORS = "(SELECT * FROM nwin WHERE split = 'donor_train')"
cte(
    "chol",
    "nsteps",
    """
SELECT r12 AS l21, l22, r13 AS l31, (r23 - r12 * r13) / l22 AS l32,
  sqrt(greatest(1 - r13 * r13 - ((r23 - r12 * r13) / l22) * ((r23 - r12 * r13) / l22), 1e-6::DOUBLE)) AS l33
FROM (SELECT *, sqrt(greatest(1 - r12 * r12, 1e-6::DOUBLE)) AS l22
      FROM (SELECT corr(c0, c1) AS r12, corr(c0, c2) AS r13, corr(c1, c2) AS r23 FROM nsteps WHERE split = 'donor_train'))
""",
)
cte("seeds", "", "SELECT * FROM (VALUES (42), (123), (2026)) s(seed)")
cte(
    "draws",
    "nwin seeds",
    f"""
SELECT d.idx AS id, s.seed,
  floor({unit("d.idx || ':' || s.seed || ':index'")} * (SELECT count(*) FROM {DONORS}))::BIGINT AS donor_idx,
  list_transform(range(195), lambda k: {norm("d.idx || ':' || s.seed || ':' || k")}) AS z
FROM {DONORS} d, seeds s
""",
)


def shocks(sigma: float) -> str:
    """Session-major channel-correlated shocks from the normals ``z``."""
    return f"""flatten(list_transform(range(65), lambda t: [{sigma}::DOUBLE * z[3*t+1],
  {sigma}::DOUBLE * (l21 * z[3*t+1] + l22 * z[3*t+2]),
  {sigma}::DOUBLE * (l31 * z[3*t+1] + l32 * z[3*t+2] + l33 * z[3*t+3])]))"""


def ar_noise(rho: float, e: str = "e") -> str:
    """AR(1) noise as the closed sum over the shocks."""
    w = f"sqrt(1 - {rho}::DOUBLE * {rho}::DOUBLE)"
    return f"""list_transform(range(195), lambda k: list_sum(list_transform(range(k // 3 + 1),
  lambda s: (CASE WHEN s = 0 THEN 1::DOUBLE ELSE {w} END) * pow({rho}::DOUBLE, k // 3 - s) * {e}[3 * s + k % 3 + 1])))"""


cte(
    "pools3",
    "draws nwin chol",
    f"""
SELECT 'bootstrap_jitter' AS method, seed, id, list_transform(flat, lambda x, i: x + 0.05::DOUBLE * z[i]) AS flat
FROM draws JOIN {DONORS} d ON d.idx = donor_idx
UNION ALL
SELECT 'correlated_jitter', seed, id, list_transform(flat, lambda x, i: x + e[i])
FROM (SELECT seed, id, flat, {shocks(0.10)} AS e FROM draws JOIN {DONORS} d ON d.idx = donor_idx, chol)
UNION ALL
SELECT 'ar1_jitter', seed, id, list_transform(flat, lambda x, i: x + n[i])
FROM (SELECT seed, id, flat, {ar_noise(0.85)} AS n
      FROM (SELECT seed, id, flat, {shocks(0.10)} AS e FROM draws JOIN {DONORS} d ON d.idx = donor_idx, chol))
""",
)
# Queries on the seed-42 pools alone use these, with the same text but one seed.
cte("draws42", CTE["draws"][0][0], CTE["draws"][1].replace("d, seeds s", "d, (SELECT 42 AS seed) s"))
cte("pools", "draws42 nwin chol", CTE["pools3"][1].replace("FROM draws ", "FROM draws42 "))
cte(
    "calpool",
    "pools cal",
    """
SELECT method, id, p.flat AS z, list_transform(p.flat, lambda x, i: [m0, m1, m2][(i - 1) % 3 + 1] + [s0, s1, s2][(i - 1) % 3 + 1] * x) AS flat
FROM pools p, cal
""",
)
cte("calsteps", "calpool", "SELECT method, id, t, flat[3*t+1] AS c0, flat[3*t+2] AS c1, flat[3*t+3] AS c2 FROM calpool, (SELECT unnest(range(65)) AS t)")
cte("psteps", "pools", "SELECT method, id, t, flat[3*t+1] AS c0, flat[3*t+2] AS c1, flat[3*t+3] AS c2 FROM pools, (SELECT unnest(range(65)) AS t)")
cte(
    "validity",
    "calpool",
    """
SELECT method, id, list_bool_and(list_transform(flat, lambda x: isfinite(x)))
  AND list_bool_and(list_transform(range(65), lambda t: flat[3*t+2] >= 0 AND flat[3*t+3] >= 0)) AS ok
FROM calpool
""",
)

# Donors by regime.
cte(
    "summ",
    "nwin",
    f"""
SELECT idx, sqrt(list_sum(list_transform(r, lambda x: (x - list_sum(r) / 65) * (x - list_sum(r) / 65))) / 65) AS ret_std,
  list_sum(list_transform(r, lambda x: abs(x))) / 65 AS ret_abs_mean, list_sum(r) AS ret_sum, list_sum(h) / 65 AS range_mean,
  list_sum(v) / 65 AS volume_mean, sqrt(list_sum(list_transform(v, lambda x: (x - list_sum(v) / 65) * (x - list_sum(v) / 65))) / 65) AS volume_std
FROM (SELECT idx, list_transform(range(65), lambda t: flat[3*t+1]) AS r, list_transform(range(65), lambda t: flat[3*t+2]) AS h,
  list_transform(range(65), lambda t: flat[3*t+3]) AS v FROM {DONORS})
""",
)
cte(
    "regime",
    "summ",
    """
SELECT s.*, (CASE WHEN vs >= v1 THEN 1 ELSE 0 END + CASE WHEN vs >= v2 THEN 1 ELSE 0 END) * 6
  + (CASE WHEN ret_sum >= t1 THEN 1 ELSE 0 END + CASE WHEN ret_sum >= t2 THEN 1 ELSE 0 END) * 2
  + CASE WHEN volume_mean >= u1 THEN 1 ELSE 0 END AS regime
FROM (SELECT *, 0.5::DOUBLE * ret_std + 0.5::DOUBLE * range_mean AS vs FROM summ) s,
  (SELECT quantile_cont(0.5::DOUBLE * ret_std + 0.5::DOUBLE * range_mean, 1.0::DOUBLE / 3) AS v1, quantile_cont(0.5::DOUBLE * ret_std + 0.5::DOUBLE * range_mean, 2.0::DOUBLE / 3) AS v2,
    quantile_cont(ret_sum, 1.0::DOUBLE / 3) AS t1, quantile_cont(ret_sum, 2.0::DOUBLE / 3) AS t2, quantile_cont(volume_mean, 0.5) AS u1 FROM summ)
""",
)
SUMMARY = ("ret_std", "ret_abs_mean", "ret_sum", "range_mean", "volume_mean", "volume_std")
cte(
    "zsumm",
    "regime",
    "SELECT idx, regime, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in SUMMARY)
    + " FROM regime, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SUMMARY)
    + " FROM regime)",
)
cte(
    "knn",
    "zsumm",
    """
SELECT regime, idx, mate, distance, rank FROM (
  SELECT a.regime, a.idx, b.idx AS mate, sqrt("""
    + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in SUMMARY)
    + """) AS distance,
    row_number() OVER (PARTITION BY a.idx ORDER BY sqrt("""
    + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in SUMMARY)
    + """), b.idx) AS rank
  FROM zsumm a JOIN zsumm b ON a.regime = b.regime AND a.idx <> b.idx) WHERE rank <= 12
UNION ALL SELECT regime, idx, idx, 0, 1 FROM zsumm WHERE regime IN (SELECT regime FROM zsumm GROUP BY regime HAVING count(*) = 1)
""",
)
cte(
    "shares",
    "regime",
    """
SELECT regime, n, (sum(n) OVER (ORDER BY regime) - n) / sum(n) OVER () AS lo
FROM (SELECT regime, count(*)::DOUBLE AS n FROM regime GROUP BY regime)
""",
)
cte(
    "regdraw",
    "regime shares",
    f"""
SELECT d.id, d.regime, m.idx AS donor_idx FROM (
  SELECT i.id, arg_max(s.regime, s.lo) AS regime,
    floor({unit("i.id || ':42:member'")} * arg_max(s.n, s.lo))::BIGINT AS member
  FROM (SELECT idx AS id FROM regime) i JOIN shares s ON s.lo <= {unit("i.id || ':42:regime'")} GROUP BY i.id) d
JOIN (SELECT idx, regime, row_number() OVER (PARTITION BY regime ORDER BY idx) - 1 AS member FROM regime) m
  ON m.regime = d.regime AND m.member = d.member
""",
)
cte(
    "mix",
    "regdraw knn nwin",
    f"""
SELECT id, donor_idx, mate, w, list_transform(a.flat, lambda x, i: w * x + (1 - w) * b.flat[i]) AS flat
FROM (SELECT r.id, r.donor_idx, k.mate,
    CASE WHEN {unit("r.id || ':42:mirror'")} < 0.5 THEN beta ELSE 1 - beta END AS w
  FROM (SELECT d.*, (SELECT count(*) FROM knn WHERE knn.idx = d.donor_idx) AS n_near,
          list_sort(list_transform(range(9), lambda j: {unit("d.id || ':42:beta' || j")}))[8] AS beta FROM regdraw d) r
  JOIN knn k ON k.idx = r.donor_idx AND k.rank = floor({unit("r.id || ':42:mate'")} * n_near) + 1) m
JOIN {DONORS} a ON a.idx = m.donor_idx JOIN {DONORS} b ON b.idx = m.mate
""",
)
cte("noise42", "draws42 chol", f"SELECT id, {ar_noise(0.85)} AS n FROM (SELECT id, {shocks(1.0)} AS e FROM draws42, chol)")

# Evaluation: validation windows as "real" and a shared subset of each pool.
VALID = "(SELECT * FROM nwin WHERE split = 'donor_validation')"
cte(
    "subset",
    "nwin",
    f"SELECT idx AS id FROM {DONORS} ORDER BY md5(idx || ':42:order'), idx LIMIT (SELECT count(*) FROM {VALID})",
)
cte(
    "ev",
    "pools subset nwin",
    f"SELECT 'real' AS method, idx AS window_id, flat FROM {VALID} UNION ALL SELECT method, id, flat FROM pools WHERE id IN (SELECT id FROM subset)",
)
cte("evsteps", "ev", "SELECT method, window_id, t, flat[3*t+1] AS c0, flat[3*t+2] AS c1, flat[3*t+3] AS c2 FROM ev, (SELECT unnest(range(65)) AS t)")
cte("evlong", "evsteps chan", "SELECT method, window_id, t, channel, ci, [c0, c1, c2][ci + 1] AS x FROM evsteps, chan")
cte(
    "w1",
    "evlong",
    """
SELECT m AS method, channel, sum(abs(cs / ns - cr / nr) * (nx - x)) AS w FROM (
  SELECT m, channel, x, sum(s) OVER o AS cs, sum(r) OVER o AS cr, sum(s) OVER p AS ns, sum(r) OVER p AS nr, lead(x) OVER o AS nx
  FROM (SELECT m, channel, x, sum((method = m)::INT)::DOUBLE AS s, sum((method = 'real')::INT)::DOUBLE AS r
        FROM evlong, (SELECT DISTINCT method AS m FROM evlong WHERE method <> 'real') WHERE method IN (m, 'real') GROUP BY 1, 2, 3)
  WINDOW o AS (PARTITION BY m, channel ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY m, channel))
WHERE nx IS NOT NULL GROUP BY 1, 2
""",
)


def acf(source: str, value: str, lags: int) -> str:
    """(method, window_id, ci, lag, acf) of ``value`` from a long table."""
    return f"""
SELECT method, window_id, ci, k AS lag, CASE WHEN v > 0 THEN list_sum(list_transform(range(1, 66 - k), lambda j: d[j] * d[j + k])) / v END AS acf
FROM (SELECT method, window_id, ci, list_transform(s, lambda x: x - list_sum(s) / 65) AS d,
        list_sum(list_transform(s, lambda x: (x - list_sum(s) / 65) * (x - list_sum(s) / 65))) AS v
      FROM (SELECT method, window_id, ci, list({value} ORDER BY t) AS s FROM {source} GROUP BY 1, 2, 3)), (SELECT unnest(range(1, {lags + 1})) AS k)
"""


cte("acf_ret", "evlong", acf("(SELECT * FROM evlong WHERE ci = 0)", "x", 20))
cte("acf_abs", "evlong", acf("(SELECT * FROM evlong WHERE ci = 0)", "abs(x)", 20))
for _name in ("acf_ret", "acf_abs"):
    cte(
        f"{_name}_table",
        _name,
        f"""
SELECT s.method, s.lag, r.acf AS real_acf, s.acf AS synthetic_acf, s.acf - r.acf AS difference, abs(s.acf - r.acf) AS gap,
  avg(abs(s.acf - r.acf)) OVER (PARTITION BY s.method) AS acf_mae, r.n AS real_valid, s.n AS synthetic_valid
FROM (SELECT method, lag, avg(acf) AS acf, count(acf) AS n FROM {_name} WHERE method <> 'real' GROUP BY 1, 2) s
JOIN (SELECT lag, avg(acf) AS acf, count(acf) AS n FROM {_name} WHERE method = 'real' GROUP BY 1) r USING (lag)
""",
    )
cte(
    "corrm",
    "evsteps",
    """
SELECT method, unnest([{r: 0, c: 0, v: 1::DOUBLE}, {r: 1, c: 1, v: 1::DOUBLE}, {r: 2, c: 2, v: 1::DOUBLE}, {r: 0, c: 1, v: ab}, {r: 1, c: 0, v: ab},
  {r: 0, c: 2, v: ac}, {r: 2, c: 0, v: ac}, {r: 1, c: 2, v: bc}, {r: 2, c: 1, v: bc}], recursive := true)
FROM (SELECT method, corr(c0, c1) AS ab, corr(c0, c2) AS ac, corr(c1, c2) AS bc FROM evsteps GROUP BY method)
""",
)
cte(
    "correrr",
    "corrm",
    """
SELECT a.method, avg(abs(a.v - b.v)) AS mean_gap, max(abs(a.v - b.v)) AS max_gap
FROM corrm a JOIN corrm b ON a.r = b.r AND a.c = b.c AND b.method = 'real' WHERE a.r <> a.c AND a.method <> 'real' GROUP BY 1
""",
)
cte(
    "nn",
    "ev nwin",
    f"SELECT method, window_id, min(list_distance(e.flat, d.flat)) AS distance FROM ev e, {DONORS} d GROUP BY 1, 2",
)
cte(
    "scores",
    "nn",
    """
SELECT m AS method, 0 AS label, 1 / (1 + distance) AS score FROM nn, (SELECT DISTINCT method AS m FROM nn WHERE method <> 'real') WHERE method = 'real'
UNION ALL SELECT method, 1, 1 / (1 + distance) FROM nn WHERE method <> 'real'
""",
)
cte(
    "auc",
    "scores",
    """
SELECT a.method, sum(CASE WHEN b.score > a.score THEN 1 WHEN b.score = a.score THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS roc_auc
FROM scores a JOIN scores b ON a.method = b.method AND a.label = 0 AND b.label = 1 GROUP BY 1
""",
)
# Pairwise kernels on all rows of both sides.
MMD_SUMS = """sum(exp(-g * d)) FILTER (ra AND rb AND ka <> kb) / (n * (n - 1)) + sum(exp(-g * d)) FILTER (NOT ra AND NOT rb AND ka <> kb) / (m * (m - 1))
  - 2 * sum(exp(-g * d)) FILTER (ra AND NOT rb) / (n * m)"""
cte(
    "mmdrows",
    "pools nwin",
    f"""
SELECT m AS method, true AS is_real, flat, idx AS k FROM {VALID}, (SELECT DISTINCT method AS m FROM pools)
UNION ALL SELECT method, false, flat, id FROM pools
""",
)
cte(
    "mmd",
    "mmdrows",
    f"""
SELECT method, n, m, g AS gamma, {MMD_SUMS} AS mmd
FROM (SELECT *, 1 / greatest(median(d) OVER (PARTITION BY method), 1e-8) AS g FROM (
  SELECT a.method, a.is_real AS ra, b.is_real AS rb, a.k AS ka, b.k AS kb, pow(list_distance(a.flat, b.flat), 2) AS d, n, m
  FROM mmdrows a JOIN mmdrows b ON a.method = b.method
  JOIN (SELECT method, (count(*) FILTER (is_real))::DOUBLE AS n, (count(*) FILTER (NOT is_real))::DOUBLE AS m FROM mmdrows GROUP BY 1) c ON c.method = a.method)) GROUP BY 1, 2, 3, 4
""",
)

# Volatility features, mixtures and ridge by Gauss-Jordan elimination.
FEATURES = ("rv5", "rv20", "rv60", "mean_abs_return20", "momentum20", "mean_range20", "mean_log_volume20", "std_log_volume20")


def vol(keep: str, source: str) -> str:
    rms = lambda a, k: f"sqrt(252.0::DOUBLE / {k} * list_sum(list_transform({a}, lambda x: x * x)))"
    return f"""
SELECT {keep}, {rms('r[56:60]', 5)} AS rv5, {rms('r[41:60]', 20)} AS rv20, {rms('r[1:60]', 60)} AS rv60,
  list_sum(list_transform(r[41:60], lambda x: abs(x))) / 20 AS mean_abs_return20, list_sum(r[41:60]) AS momentum20,
  list_sum(h[41:60]) / 20 AS mean_range20, list_sum(v[41:60]) / 20 AS mean_log_volume20,
  sqrt(list_sum(list_transform(v[41:60], lambda x: pow(x - list_sum(v[41:60]) / 20, 2))) / 20) AS std_log_volume20, {rms('r[61:65]', 5)} AS y
FROM (SELECT *, list_transform(range(65), lambda t: flat[3*t+1]) AS r, list_transform(range(65), lambda t: flat[3*t+2]) AS h,
  list_transform(range(65), lambda t: flat[3*t+3]) AS v FROM {source})
"""


XS = ", ".join(FEATURES)
cte("realvf", "win", vol("start_pos", "(SELECT * FROM win WHERE split = 'visible')"))
cte("synvf", "calpool validity", vol("method, id", "(SELECT method, id, flat FROM calpool JOIN validity USING (method, id) WHERE ok)"))
cte("testvf", "testwin", vol("test_row", "testwin"))
cte("fullvf", "win", vol("start_pos", "(SELECT * FROM win WHERE split = 'full_history')"))
cte(
    "design",
    "realvf",
    """
SELECT ratio, (SELECT count(*) FROM realvf) AS n_real, round_even((SELECT count(*) FROM realvf) * ratio / (1 - ratio), 0)::BIGINT AS n_synthetic
FROM (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) r(ratio)
""",
)
cte(
    "mixsyn",
    "synvf design seeds",
    """
SELECT s.method, d.ratio, s.seed, s.id, s.* EXCLUDE (method, id, seed, k) FROM (
  SELECT f.*, seed, row_number() OVER (PARTITION BY method, seed ORDER BY md5(id || ':' || seed || ':order'), id) AS k FROM synvf f, seeds) s
JOIN design d ON s.k <= d.n_synthetic
""",
)
cte(
    "train",
    "mixsyn realvf design seeds",
    f"""
SELECT 'REAL_ONLY' AS method, 0::DOUBLE AS ratio, 0 AS seed, [{XS}, y] AS v FROM realvf
UNION ALL SELECT method, ratio, seed, [{XS}, y] FROM (SELECT DISTINCT method FROM mixsyn), (SELECT ratio FROM design WHERE ratio > 0), seeds, realvf
UNION ALL SELECT method, ratio, seed, [{XS}, y] FROM mixsyn
""",
)


def ridge(prefix: str, train: str, scale: str) -> None:
    """Models of every (method, ratio, seed) in ``train``; ``scale`` gives (i, s) or is per set."""
    key = "method, ratio, seed"
    cte(
        f"{prefix}mom",
        train,
        f"""
SELECT {key}, i, j, count(*) AS n, covar_pop(v[i], v[j]) * count(*) AS c, avg(v[i]) AS m, stddev_pop(v[i]) AS own
FROM {train}, (SELECT unnest(range(1, 10)) AS i), (SELECT unnest(range(1, 10)) AS j) GROUP BY {key}, i, j
""",
    )
    cte(
        f"{prefix}aug",
        f"{prefix}mom {'realvf' if scale == 'real' else ''}",
        f"""
SELECT {key}, any_value(n) AS n, list(line ORDER BY i) AS m, list(s ORDER BY i) AS s, list(mean ORDER BY i) AS x, any_value(ym) AS ym FROM (
  SELECT {key}, i, any_value(n) AS n, any_value(si) AS s, any_value(m) AS mean, any_value(ym) AS ym,
    list(CASE WHEN j <= 8 THEN c / (si * sj) + CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END ELSE c / si END ORDER BY j) AS line
  FROM (SELECT a.*, y.m AS ym, {
            "sc.s[a.i] AS si, sc.s[a.j] AS sj" if scale == "real" else "a.own AS si, b.own AS sj"
        } FROM {prefix}mom a
    JOIN (SELECT {key}, m FROM {prefix}mom WHERE i = 9 AND j = 9) y USING ({key})
    {"" if scale == "real" else f"JOIN (SELECT {key}, i AS j, own FROM {prefix}mom WHERE j = 1) b USING ({key}, j)"}
    {f", (SELECT [{', '.join(f'stddev_pop({f})' for f in FEATURES)}, 1] AS s FROM realvf) sc" if scale == "real" else ""}
    WHERE i <= 8) GROUP BY {key}, i) GROUP BY {key}
""",
    )
    cte(
        f"{prefix}gj",
        f"{prefix}aug",
        f"""
SELECT {key}, 0 AS k, m FROM {prefix}aug
UNION ALL
SELECT {key}, k + 1, list_transform(range(1, 9), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
  ELSE list_transform(m[i], lambda x, j: x - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {prefix}gj WHERE k < 8
""",
    )
    cte(
        f"{prefix}models",
        f"{prefix}gj {prefix}aug",
        f"""
SELECT {key}, n, coef, w, ym - list_sum(list_transform(w, lambda a, i: a * x[i])) AS intercept FROM (
  SELECT {key}, a.n, a.x, a.ym, list_transform(range(1, 9), lambda i: g.m[i][9]) AS coef, list_transform(range(1, 9), lambda i: g.m[i][9] / a.s[i]) AS w
  FROM {prefix}gj g JOIN {prefix}aug a USING ({key}) WHERE k = 8)
""",
    )
    cte(
        f"{prefix}raw",
        f"{prefix}models testvf",
        f"""
SELECT {key}, count(*) AS n_test, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM (
  SELECT {key}, intercept + list_sum(list_transform([{XS}], lambda a, i: a * w[i])) - y AS e FROM {prefix}models, testvf) GROUP BY {key}
""",
    )


ridge("", "train", "real")
cte(
    "fulltrain",
    "realvf fullvf mixsyn",
    f"""
SELECT 'visible' AS method, 0::DOUBLE AS ratio, 0 AS seed, [{XS}, y] AS v FROM realvf
UNION ALL SELECT 'full_history', 0, 0, [{XS}, y] FROM fullvf
UNION ALL SELECT m.method, 0.75, 42, [{XS}, y] FROM realvf, (SELECT DISTINCT method FROM mixsyn) m
UNION ALL SELECT method, ratio, seed, [{XS}, y] FROM mixsyn WHERE ratio = 0.75 AND seed = 42
""",
)
ridge("full", "fulltrain", "own")
cte(
    "halftrain",
    "realvf fullvf mixsyn",
    f"""
SELECT 'visible' AS method, 0::DOUBLE AS ratio, 0 AS seed, [{XS}, y] AS v FROM realvf
UNION ALL SELECT 'full_history', 0, 0, [{XS}, y] FROM fullvf
UNION ALL SELECT m.method, 0.5, 42, [{XS}, y] FROM realvf, (SELECT DISTINCT method FROM mixsyn) m
UNION ALL SELECT method, ratio, seed, [{XS}, y] FROM mixsyn WHERE ratio = 0.5 AND seed = 42
""",
)
ridge("half", "halftrain", "own")
cte(
    "usummary",
    "raw",
    """
SELECT *, mean_rmse - rr AS delta_rmse, (mean_rmse - rr) / rr * 100 AS delta_rmse_pct, mean_mae - rm AS delta_mae, (mean_mae - rm) / rm * 100 AS delta_mae_pct
FROM (SELECT method, ratio, avg(rmse) AS mean_rmse, stddev_pop(rmse) AS std_rmse, avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae FROM raw GROUP BY 1, 2),
  (SELECT rmse AS rr, mae AS rm FROM raw WHERE method = 'REAL_ONLY')
""",
)
cte(
    "master",
    "usummary",
    """
SELECT method AS method_id, CASE method WHEN 'bootstrap_jitter' THEN 'Bootstrap + jitter' WHEN 'correlated_jitter' THEN 'Correlated jitter' ELSE 'AR(1) jitter' END AS method_name,
  ratio AS synthetic_ratio, mean_rmse AS rmse_mean, std_rmse AS rmse_std, mean_mae AS mae_mean, std_mae AS mae_std, rr AS real_only_rmse, rm AS real_only_mae,
  rr - mean_rmse AS rmse_improvement_abs, (rr - mean_rmse) / rr * 100 AS rmse_improvement_pct, rm - mean_mae AS mae_improvement_abs, (rm - mean_mae) / rm * 100 AS mae_improvement_pct
FROM usummary WHERE method <> 'REAL_ONLY'
""",
)
cte(
    "stability",
    "raw",
    """
SELECT method AS method_id, ratio AS synthetic_ratio, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std, min(rmse) AS rmse_min, max(rmse) AS rmse_max,
  max(rmse) - min(rmse) AS rmse_range, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, min(mae) AS mae_min, max(mae) AS mae_max, max(mae) - min(mae) AS mae_range,
  stddev_pop(rmse) / avg(rmse) AS rmse_cv, count(*) AS n_seeds FROM raw WHERE method <> 'REAL_ONLY' GROUP BY 1, 2
""",
)
cte(
    "modelsum",
    "master stability",
    """
SELECT m.method_id, m.method_name, arg_min(m.synthetic_ratio, m.rmse_mean) AS best_rmse_ratio, min(m.rmse_mean) AS best_rmse_mean, arg_min(m.rmse_std, m.rmse_mean) AS best_rmse_std,
  arg_min(m.rmse_improvement_pct, m.rmse_mean) AS best_rmse_improvement_pct, arg_min(m.synthetic_ratio, m.mae_mean) AS best_mae_ratio, min(m.mae_mean) AS best_mae_mean,
  arg_min(m.mae_improvement_pct, m.mae_mean) AS best_mae_improvement_pct, avg(m.rmse_mean) AS mean_rmse_across_ratios,
  avg(m.rmse_improvement_pct) AS mean_rmse_improvement_across_ratios, arg_min(m.synthetic_ratio, s.rmse_std) AS most_stable_ratio
FROM master m JOIN stability s USING (method_id, synthetic_ratio) GROUP BY 1, 2
""",
)
cte(
    "fidmaster",
    "correrr nn w1 acf_ret_table acf_abs_table",
    """
SELECT c.method AS method_id, c.mean_gap AS mean_correlation_error, n.nn_mean AS nearest_neighbor_mean, n.nn_median AS nearest_neighbor_median,
  w.w0 AS wasserstein_log_return, w.w1 AS wasserstein_log_high_low_range, w.w2 AS wasserstein_log1p_volume, r.m AS return_acf_mae, b.m AS abs_return_acf_mae
FROM correrr c JOIN (SELECT method, avg(distance) AS nn_mean, median(distance) AS nn_median FROM nn GROUP BY 1) n USING (method)
JOIN (SELECT method, max(w) FILTER (channel = 'log_return') AS w0, max(w) FILTER (channel = 'log_high_low_range') AS w1, max(w) FILTER (channel = 'log1p_volume') AS w2 FROM w1 GROUP BY 1) w USING (method)
JOIN (SELECT method, avg(acf_mae) AS m FROM acf_ret_table GROUP BY 1) r USING (method) JOIN (SELECT method, avg(acf_mae) AS m FROM acf_abs_table GROUP BY 1) b USING (method)
""",
)
