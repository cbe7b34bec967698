"""Cleaning, splits, features and windows on hand-made frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.config import PROTOCOL, Protocol
from tickloom.operators import clean, features, scaling, splits, windows
from tickloom.sources import panel

OHLCV = "date date, ticker string, open double, high double, low double, close double, volume double"


def day(n: int) -> dt.date:
    return dt.date(1995, 1, 1) + dt.timedelta(days=n)


def test_tolerance_keeps_float_edges_and_rejects_errors(spark):
    rows = [
        (day(0), "A", 10.0, 10.0 - 1e-14, 9.0, 10.0, 5.0),
        (day(1), "A", 10.0, 9.99, 9.0, 10.0, 5.0),
        (day(2), "A", 10.0, 11.0, 9.0, 10.0, -1.0),
    ]
    df = spark.createDataFrame(rows, OHLCV)
    assert [r.date for r in clean.valid_rows(df).collect()] == [day(0)]
    checks = clean.row_checks(df).first()
    assert (checks.strict_failures, checks.float_edge_rescued, checks.invariant_drops) == (3, 1, 2)


def test_null_or_nan_rows_go(spark):
    rows = [(day(0), "A", 1.0, 1.0, 1.0, None, 1.0), (day(1), "A", 1.0, float("nan"), 1.0, 1.0, 1.0), (day(2), "A", 1.0, 1.0, 1.0, 1.0, 0.0)]
    assert clean.valid_rows(spark.createDataFrame(rows, OHLCV)).count() == 1


def test_calendar_counts_every_ticker_before_the_drop(spark):
    rows = [(day(n), "A", 1.0, 1.0, 1.0, 1.0, 1.0) for n in range(10)] + [(day(n), "B", 1.0, 1.0, 1.0, 1.0, 1.0) for n in range(8, 12)]
    df = spark.createDataFrame(rows, OHLCV)
    cover = {r.ticker: r.coverage for r in clean.coverage(df).collect()}
    assert cover == {"A": 10 / 12, "B": 4 / 12}
    kept = clean.drop_low_coverage(df, Protocol(min_coverage=0.5))
    assert {r.ticker for r in kept.collect()} == {"A"}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="volume"):
        clean.require_columns(spark.createDataFrame([(1.0,)], "close double"), ("close", "volume"))


def test_zero_volume_stays_and_first_return_goes(spark):
    rows = [("b", day(n), "A", 1.0, 2.0, 1.0, math.exp(n), v) for n, v in enumerate((5.0, 0.0, 9.0))]
    df = spark.createDataFrame(rows, "feature_block string, " + OHLCV)
    got = sorted(features.daily_features(df).collect(), key=lambda r: r.date)
    assert [r.date for r in got] == [day(1), day(2)]
    assert [round(r.log_return, 12) for r in got] == [1.0, 1.0]
    assert got[0].log1p_volume == 0.0 and got[1].log1p_volume == pytest.approx(math.log(10))


def test_split_labels_are_exclusive_and_blocks_overlap(spark):
    rows = [(dt.date(2000, 8, 1), "T0", *[1.0] * 5), (dt.date(2000, 8, 1), "T1", *[1.0] * 5), (dt.date(1990, 1, 1), "T1", *[1.0] * 5)]
    df = spark.createDataFrame(rows, OHLCV)
    labels = {(r.date.year, r.ticker): r.split for r in splits.assign_split(df).collect()}
    assert labels == {(2000, "T0"): "visible", (2000, "T1"): "donor_validation", (1990, "T1"): "unused"}
    blocks = sorted((r.ticker, r.feature_block) for r in splits.feature_blocks(df).collect())
    assert blocks == [("T0", "full_history"), ("T0", "test_source"), ("T0", "visible"), ("T1", "donor_validation")]
    report = {r.split: r.n_rows for r in splits.split_report(splits.assign_split(df)).collect()}
    assert report["donor_train"] == 0 and report["unused"] == 1


def feature_rows(spark, n: int, block: str = "b", ticker: str = "A", start: int = 0):
    rows = [(block, day(start + k), ticker, float(k), float(k) + 0.25, float(k) + 0.5) for k in range(n)]
    return spark.createDataFrame(rows, "feature_block string, date date, ticker string, log_return double, log_high_low_range double, log1p_volume double")


@pytest.mark.parametrize("run_rows", [65, 70, 128, 1024])
def test_windows_do_not_depend_on_the_run_size(spark, run_rows):
    df = feature_rows(spark, 400).unionByName(feature_rows(spark, 64, ticker="B"))
    got = windows.cut_windows(df, ["feature_block", "ticker"], 5, run_rows=run_rows).toPandas().sort_values("start_pos")
    assert got.start_pos.tolist() == list(range(0, 400 - 64, 5))
    for row in got.itertuples():
        want = (np.arange(65)[:, None] + row.start_pos + np.array([0, 0.25, 0.5])).ravel()
        assert np.array_equal(np.array(row.features_flat), want)
        assert row.window_start_date == day(row.start_pos) and row.window_end_date == day(row.start_pos + 64)


def test_test_index_strides_from_the_first_valid_start(spark):
    offset = (dt.date(2000, 9, 3) - dt.date(1995, 1, 1)).days
    df = feature_rows(spark, 300, "test_source", PROTOCOL.target, offset)
    got = windows.test_index(df).toPandas().sort_values("test_row")
    targets = [d for row in got.target_dates for d in row]
    assert len(targets) == len(set(targets)) and min(targets) == dt.date(2001, 1, 1)
    assert got.start_pos.diff().dropna().eq(5).all()
    assert all(len(c) == 60 for c in got.context_dates)


def test_unique_days_of_overlapping_windows(spark):
    cut = windows.cut_windows(feature_rows(spark, 69), ["ticker"], 1)
    days = windows.unique_daily(cut, 1).toPandas().sort_values("daily_pos")
    assert days.daily_pos.tolist() == list(range(69))
    assert days.log_return.tolist() == [float(k) for k in range(69)]


def test_wrong_width_stops_the_job(spark):
    df = spark.createDataFrame([(1, [1.0] * 194)], "id int, features_flat array<double>")
    with pytest.raises(Exception, match="window width 194"):
        windows.window_long(df, ["id"]).collect()


def test_normalizer_ignores_validation_and_guards_zero_std(spark):
    flat = [float(k % 3) for k in range(195)]
    df = spark.createDataFrame([(1, flat), (2, flat)], "id int, features_flat array<double>")
    scaler = scaling.fit_normalizer(df)
    got = scaling.normalize(df, scaler).first().features_flat
    assert got == [0.0] * 195
    back = scaling.denormalize(scaling.normalize(df, scaler), scaler).first().features_flat
    assert back == flat


def test_bars_from_trades_with_nulls_and_ties(spark):
    noon = dt.datetime(2020, 1, 2, 12)
    rows = [
        # (order, line, part, supplier, quantity, price, date)
        (7, 1, 1, 5, 1.0, 10.0, noon), (7, 1, 1, 5, 2.0, 10.0, noon), (7, 2, 1, 5, 1.0, 30.0, noon), (3, 9, 1, 10, 1.0, 20.0, noon),
        (3, 9, None, 10, 4.0, 20.0, noon), (5, 1, 1, 1, 1.0, 8.0, noon), (None, 2, 1, 6, 1.0, 9.0, noon), (None, 1, 1, 6, 0.5, 9.0, noon),
        (4, 1, 1, None, 1.0, 2.0, noon), (4, 1, 1, 2, 1.0, 3.0, None), (4, 2, 1, 2, 1.0, None, None),
    ]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    bars = panel.trades_to_panel(spark.createDataFrame(rows, schema))
    found = {(r.ticker, r.date): (r.open, r.high, r.low, r.close, r.volume) for r in bars.collect()}
    assert found == {
        ("T0", noon.date()): (5.0, 30.0, 5.0, 30.0, 9.0),
        ("T1", noon.date()): (18.0, 18.0, 8.0, 8.0, 2.5),
        (None, noon.date()): (2.0, 2.0, 2.0, 2.0, 1.0),
        ("T2", None): (3.0, 3.0, 3.0, None, 2.0),
    }
    # Full keys, whose aggregate sorts, are compared for the trades at an edge only.
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan[plan.index("partial_min_by"):]
