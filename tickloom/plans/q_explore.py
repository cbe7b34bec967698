"""Queries: exploration of the clean panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import PROTOCOL
from ..functions.arrays import r6
from ..operators import correlate, explore, features
from ..session import stage
from .inputs import Inputs, query, text
from .oracle import r6 as R, sql
from .q_fidelity import rounded

TICKERS = ["T0", "T1", "T2", "T3", "T4"]
RETS = """
, rets AS MATERIALIZED (SELECT * FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM panel) WHERE r IS NOT NULL)
"""


def returns(i: Inputs) -> DataFrame:
    return stage(features.with_log_return(i.panel, ["ticker"]).where(F.col("log_return").isNotNull()), "returns")


@query(
    "panel_overview",
    sql(
        "panel",
        """
SELECT ticker, count(DISTINCT date) AS n_days, count(*) AS n_rows, min(date)::VARCHAR AS min_date, max(date)::VARCHAR AS max_date,
  (SELECT count(*) FROM panel) AS panel_rows, (SELECT count(DISTINCT ticker) FROM panel) AS n_tickers, (SELECT count(DISTINCT date) FROM panel) AS union_days
FROM panel GROUP BY ticker""",
    ),
)
def panel_overview(i: Inputs) -> DataFrame:
    table = explore.overview(i.panel)
    return table.withColumns({"min_date": text("min_date"), "max_date": text("max_date")})


@query(
    "calendar_gaps",
    sql(
        "panel",
        "SELECT ticker, (SELECT count(DISTINCT date) FROM panel) - count(DISTINCT date) AS missing_sessions FROM panel GROUP BY ticker",
    ),
)
def calendar_gaps(i: Inputs) -> DataFrame:
    return explore.calendar_gaps(i.panel)


@query(
    "close_wide",
    sql("panel", "SELECT date::VARCHAR AS date, " + ", ".join(f"max(close) FILTER (ticker = '{t}') AS {t.lower()}" for t in TICKERS) + " FROM panel GROUP BY date"),
)
def close_wide(i: Inputs) -> DataFrame:
    wide = explore.wide(i.panel, "close", TICKERS)
    return wide.select(text("date").alias("date"), *[F.col(t).alias(t.lower()) for t in TICKERS])


@query(
    "panel_volume",
    sql("dirty", "SELECT date::VARCHAR AS date, sum(volume) AS volume, count(*) FILTER (volume = 0) AS zero_volume_rows FROM dirty GROUP BY date"),
)
def panel_volume(i: Inputs) -> DataFrame:
    return explore.daily_volume(i.dirty).withColumn("date", text("date"))


@query(
    "return_stats",
    sql(
        "panel",
        RETS
        + f"SELECT ticker, count(*) AS n, {R('avg(r)', 'mean')}, {R('stddev_samp(r)', 'std')}, {R('skewness(r)', 'skew')}, {R('kurtosis(r)', 'kurtosis')} FROM rets GROUP BY ticker",
    ),
)
def return_stats(i: Inputs) -> DataFrame:
    return rounded(explore.return_stats(returns(i), ["ticker"]), ["ticker", "n"], ["mean", "std", "skew", "kurtosis"])


@query(
    "large_moves",
    sql("panel", RETS + f"SELECT date::VARCHAR AS date, ticker, {R('r', 'log_return')} FROM rets WHERE abs(r) > 0.15 ORDER BY abs(r) DESC, date, ticker LIMIT 15"),
)
def large_moves(i: Inputs) -> DataFrame:
    return explore.large_moves(returns(i), 0.15, 15).select(text("date").alias("date"), "ticker", r6("log_return").alias("log_return"))


RANGE_NAMES = [f"{c}_{s}" for c in ("hl_over_c", "ln_hl") for s in ("mean", "median", "std")]


@query(
    "range_stats",
    sql(
        "panel",
        f"""SELECT ticker, {', '.join(R(f'{f}({c})', f'{c}_{s}') for c in ('hl_over_c', 'ln_hl') for s, f in (('mean', 'avg'), ('median', 'median'), ('std', 'stddev_samp')))}
FROM (SELECT ticker, (high - low) / close AS hl_over_c, ln(high / low) AS ln_hl FROM panel) GROUP BY ticker""",
    ),
)
def range_stats(i: Inputs) -> DataFrame:
    return rounded(explore.range_stats(i.panel), ["ticker"], RANGE_NAMES)


PAIRS = """, pairs AS (SELECT a.ticker AS t1, b.ticker AS t2, corr(a.r, b.r) AS c, count(*) AS n FROM rets a JOIN rets b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2)
"""


@query("ticker_corr", sql("panel", RETS + PAIRS + f"SELECT t1, t2, n, {R('c', 'corr')} FROM pairs"))
def ticker_corr(i: Inputs) -> DataFrame:
    return rounded(correlate.pair_correlations(returns(i), "log_return"), ["t1", "t2", "n"], ["corr"])


@query(
    "top_bottom_pairs",
    sql(
        "panel",
        RETS
        + PAIRS
        + f"""SELECT 'top' AS side, t1, t2, {R('c', 'corr')}, row_number() OVER (ORDER BY c DESC) AS place FROM pairs QUALIFY place <= 5
UNION ALL SELECT 'bottom', t1, t2, {R('c', 'corr')}, row_number() OVER (ORDER BY c) AS place FROM pairs QUALIFY place <= 5""",
    ),
)
def top_bottom_pairs(i: Inputs) -> DataFrame:
    table = correlate.top_bottom(returns(i), "log_return", 5)
    return rounded(table, ["side", "t1", "t2", F.col("place").cast("long").alias("place")], ["corr"])


@query(
    "ticker_drilldown",
    sql(
        "panel",
        RETS
        + f"""
SELECT ticker, n_days, first_date::VARCHAR AS first_date, last_date::VARCHAR AS last_date, first_close, last_close, n, {R('mean', 'mean')}, {R('std', 'std')}, {R('skew', 'skew')}, {R('kurt', 'kurtosis')}, {R('lo', 'min')}, {R('hi', 'max')}
FROM (SELECT ticker, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close FROM panel WHERE ticker = 'T0' GROUP BY 1)
JOIN (SELECT ticker, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, skewness(r) AS skew, kurtosis(r) AS kurt, min(r) AS lo, max(r) AS hi FROM rets WHERE ticker = 'T0' GROUP BY 1) USING (ticker)""",
    ),
)
def ticker_drilldown(i: Inputs) -> DataFrame:
    table = explore.drilldown(i.panel, returns(i), PROTOCOL.target)
    keep = ["ticker", "n_days", text("first_date").alias("first_date"), text("last_date").alias("last_date"), "first_close", "last_close", "n"]
    return rounded(table, keep, ["mean", "std", "skew", "kurtosis", "min", "max"])


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query(
    "box_stats",
    sql(
        "panel",
        RETS
        + f"""
SELECT ticker, {R('q1', 'q1')}, {R('q2', 'median')}, {R('q3', 'q3')}, {R('min(r) FILTER (r >= q1 - 1.5 * (q3 - q1))', 'whisker_low')},
  {R('max(r) FILTER (r <= q3 + 1.5 * (q3 - q1))', 'whisker_high')}, count(*) FILTER (r < q1 - 1.5 * (q3 - q1) OR r > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM rets JOIN (SELECT ticker, quantile_cont(r, 0.25) AS q1, median(r) AS q2, quantile_cont(r, 0.75) AS q3 FROM rets GROUP BY 1) USING (ticker) GROUP BY ticker, q1, q2, q3""",
    ),
)
def box_stats(i: Inputs) -> DataFrame:
    return rounded(explore.box_stats(returns(i), ["ticker"], "log_return"), ["ticker", "n_outliers"], BOX)
