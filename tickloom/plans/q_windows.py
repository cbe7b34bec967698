"""Queries: windows, test index and window checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import PROTOCOL
from ..functions.arrays import checksum, r6
from ..operators import windows as win
from .inputs import Inputs, query, text
from .oracle import r6 as R, sql

CHECK_SQL = "list_sum(list_transform(flat, lambda x, i: x * i)) / 195"


def window_cells():
    flat = F.col("features_flat")
    return [
        F.size(flat).cast("long").alias("n_values"),
        r6(F.element_at(flat, 1)).alias("first_value"),
        r6(F.element_at(flat, -1)).alias("last_value"),
        r6(checksum(flat)).alias("checksum"),
    ]


CELLS_SQL = f"len(flat) AS n_values, {R('flat[1]', 'first_value')}, {R('flat[195]', 'last_value')}, {R(CHECK_SQL, 'checksum')}"


@query(
    "sliding_windows",
    sql(
        "win",
        f"SELECT split, ticker, start_pos, window_start_date::VARCHAR AS start_date, window_end_date::VARCHAR AS end_date, {CELLS_SQL} FROM win",
    ),
)
def sliding_windows(i: Inputs) -> DataFrame:
    return win.block_windows(i.features).select(
        "split", "ticker", "start_pos", text("window_start_date").alias("start_date"),
        text("window_end_date").alias("end_date"), *window_cells(),
    )


@query(
    "test_index",
    sql(
        "testwin",
        f"""SELECT test_row, ticker, start_pos, context_dates[1]::VARCHAR AS context_start, context_dates[60]::VARCHAR AS context_end,
  target_dates[1]::VARCHAR AS target_start, target_dates[5]::VARCHAR AS target_end, {CELLS_SQL} FROM testwin""",
    ),
)
def test_index(i: Inputs) -> DataFrame:
    return win.test_index(i.features).select(
        "test_row", "ticker", "start_pos",
        text(F.element_at("context_dates", 1)).alias("context_start"), text(F.element_at("context_dates", -1)).alias("context_end"),
        text(F.element_at("target_dates", 1)).alias("target_start"), text(F.element_at("target_dates", -1)).alias("target_end"),
        *window_cells(),
    )


@query(
    "window_boundary",
    sql(
        "win blocks",
        """
SELECT split, count(*) AS n_windows, min(window_start_date)::VARCHAR AS min_start, max(window_end_date)::VARCHAR AS max_end,
  min(window_start_date) >= any_value(lo) AND max(window_end_date) <= any_value(hi) AS inside
FROM win JOIN blocks ON feature_block = split GROUP BY split""",
    ),
)
def window_boundary(i: Inputs) -> DataFrame:
    return win.boundary_report(win.block_windows(i.features)).select(
        "split", "n_windows", text("min_start").alias("min_start"), text("max_end").alias("max_end"), "inside"
    )


@query(
    "target_overlap",
    sql(
        "testwin",
        """SELECT count(*) AS n_days, count(*) FILTER (n > 1) AS overlapping_days
FROM (SELECT d, count(*) AS n FROM (SELECT unnest(target_dates) AS d FROM testwin) GROUP BY d)""",
    ),
)
def target_overlap(i: Inputs) -> DataFrame:
    return win.target_overlaps(i.test_windows)


@query(
    "target_checks",
    sql(
        "testwin",
        """SELECT count(*) AS n_windows, bool_and(len(context_dates) = 60) AS context_complete, bool_and(len(target_dates) = 5) AS target_complete,
  bool_and(list_min(target_dates) >= DATE '2001-01-01') AS starts_inside, bool_and(list_max(target_dates) <= DATE '2001-11-04') AS ends_inside,
  bool_and(list_max(context_dates) < list_min(target_dates)) AS context_before_target FROM testwin""",
    ),
)
def target_checks(i: Inputs) -> DataFrame:
    return win.target_checks(i.test_windows)


@query(
    "window_counts",
    sql(
        "win testwin blocks",
        """
SELECT split, any_value(stride)::BIGINT AS stride, count(*) AS n_windows, min(s)::VARCHAR AS min_date, max(e)::VARCHAR AS max_date, 'PASS' AS status
FROM (SELECT split, stride, window_start_date AS s, window_end_date AS e FROM win JOIN blocks ON feature_block = split
      UNION ALL SELECT 'test', 5, window_start_date, window_end_date FROM testwin) GROUP BY split""",
    ),
)
def window_counts(i: Inputs) -> DataFrame:
    report = win.boundary_report(win.block_windows(i.features)).withColumn(
        "stride", win.block_stride(F.col("split")).cast("long")
    )
    test = i.test_windows.agg(
        F.lit("test").alias("split"),
        F.count(F.lit(1)).alias("n_windows"),
        F.min("window_start_date").alias("min_start"),
        F.max("window_end_date").alias("max_end"),
        F.lit(PROTOCOL.test_stride).cast("long").alias("stride"),
    ).withColumn("inside", F.col("n_windows") > 0)
    return report.unionByName(test).select(
        "split", "stride", "n_windows", text("min_start").alias("min_date"), text("max_end").alias("max_date"),
        F.when(F.col("inside"), "PASS").otherwise("FAIL").alias("status"),
    )


@query(
    "window_count_check",
    sql(
        "feat win blocks",
        """
SELECT coalesce(a.split, b.split) AS split, a.expected, b.observed, CASE WHEN a.expected = b.observed THEN 'OK' ELSE 'MISMATCH' END AS status
FROM (SELECT feature_block AS split, sum(greatest(floor((n - 65) / stride) + 1, 0))::BIGINT AS expected
      FROM (SELECT feature_block, ticker, count(*) AS n FROM feat GROUP BY 1, 2) JOIN blocks USING (feature_block)
      WHERE feature_block <> 'test_source' GROUP BY 1) a
FULL JOIN (SELECT split, count(*) AS observed FROM win GROUP BY 1) b ON a.split = b.split""",
    ),
)
def window_count_check(i: Inputs) -> DataFrame:
    expected = win.expected_counts(i.features.where(F.col("feature_block") != "test_source"))
    observed = win.block_windows(i.features).groupBy("split").agg(F.count(F.lit(1)).alias("observed"))
    status = F.when(F.col("expected") == F.col("observed"), "OK").otherwise("MISMATCH")
    return expected.join(observed, "split", "full_outer").withColumn("status", status)


@query(
    "stride_check",
    sql(
        "win blocks",
        """
SELECT split, count(*) AS n_pairs, count(*) FILTER (start_pos - prev <> stride) AS wrong_stride
FROM (SELECT split, start_pos, lag(start_pos) OVER (PARTITION BY split, ticker ORDER BY start_pos) AS prev FROM win)
JOIN blocks ON feature_block = split WHERE prev IS NOT NULL GROUP BY split""",
    ),
)
def stride_check(i: Inputs) -> DataFrame:
    return win.stride_check(i.windows)


@query(
    "hidden_windows",
    sql(
        "win",
        f"""SELECT 'hidden' AS split, ticker, start_pos, window_end_date::VARCHAR AS end_date, {CELLS_SQL}
FROM win WHERE split = 'full_history' AND window_end_date <= DATE '2000-06-30'""",
    ),
)
def hidden_windows(i: Inputs) -> DataFrame:
    return win.hidden_windows(win.block_windows(i.features)).select(
        "split", "ticker", "start_pos", text("window_end_date").alias("end_date"), *window_cells()
    )


@query(
    "window_long",
    sql(
        "steps chan",
        f"""
SELECT split, t, channel, count(*) AS n, {R('avg(x)', 'mean_value')}, {R('min(x)', 'min_value')}, {R('max(x)', 'max_value')}
FROM (SELECT split, t, channel, [c0, c1, c2][ci + 1] AS x FROM steps, chan) GROUP BY 1, 2, 3""",
    ),
)
def window_long(i: Inputs) -> DataFrame:
    long = win.window_long(win.block_windows(i.features), ["split"])
    return long.groupBy("split", F.col("t").cast("long").alias("t"), "channel").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"),
        r6(F.min("value")).alias("min_value"), r6(F.max("value")).alias("max_value"),
    )


@query(
    "unique_daily",
    sql(
        "steps",
        f"""SELECT DISTINCT split, ticker, start_pos + t AS daily_pos, {R('c0', 'log_return')}, {R('c1', 'log_high_low_range')}, {R('c2', 'log1p_volume')} FROM steps""",
    ),
)
def unique_daily(i: Inputs) -> DataFrame:
    days = win.unique_daily(win.block_windows(i.features), win.block_stride(F.col("split")), ["split", "ticker"])
    return days.select("split", "ticker", "daily_pos", *[r6(c).alias(c) for c in PROTOCOL.channels])


@query(
    "window_meta_check",
    sql(
        "win",
        """
SELECT split, count(*) AS n_windows, count(*) FILTER (ticker IS NULL OR window_start_date IS NULL OR window_end_date IS NULL) AS null_meta,
  count(*) FILTER (window_start_date > window_end_date) AS start_after_end, count(*) FILTER (len(flat) <> 195) AS wrong_length,
  count(*) FILTER (len(list_filter(flat, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS non_finite,
  count(*) FILTER (ticker NOT IN ('T1', 'T2', 'T3', 'T4')) AS unknown_ticker
FROM win GROUP BY split""",
    ),
)
def window_meta_check(i: Inputs) -> DataFrame:
    return win.meta_check(win.block_windows(i.features), ["T1", "T2", "T3", "T4"])


@query(
    "universe_check",
    sql(
        "panel blocks win",
        """
SELECT coalesce(e.split, w.split) AS split, count(e.ticker) AS n_expected, count(*) FILTER (e.ticker IS NULL) AS n_unknown,
  count(*) FILTER (w.ticker IS NULL) AS n_missing
FROM (SELECT DISTINCT feature_block AS split, ticker FROM panel, blocks WHERE (ticker = 'T0') = is_target AND feature_block <> 'test_source') e
FULL JOIN (SELECT DISTINCT split, ticker FROM win) w ON e.split = w.split AND e.ticker = w.ticker GROUP BY 1""",
    ),
)
def universe_check(i: Inputs) -> DataFrame:
    target = F.col("ticker") == PROTOCOL.target
    roles = F.array(
        *[
            F.when(target if r.role == "target" else ~target, r.name)
            for r in PROTOCOL.blocks
            if r.name != "test_source"
        ]
    )
    expected = i.panel.select("ticker").distinct().select(
        F.explode(F.array_compact(roles)).alias("split"), "ticker"
    )
    return win.universe_check(win.block_windows(i.features), expected)


@query(
    "window_profile",
    sql(
        "win",
        """SELECT split, count(*) AS n_windows, count(DISTINCT ticker) AS n_tickers, count(DISTINCT len(flat)) AS n_widths,
  min(len(flat)) AS min_width, max(len(flat)) AS max_width FROM win GROUP BY split""",
    ),
)
def window_profile(i: Inputs) -> DataFrame:
    return win.window_profile(win.block_windows(i.features))
