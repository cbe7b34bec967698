"""Queries: ingest, cleaning, splits and daily features."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL
from ..functions.arrays import r6
from ..operators import clean, features, splits
from ..session import shared_dir
from ..sources import layout, panel as src
from .inputs import Inputs, query, text
from .oracle import FULL, TOL, ok, r6 as R, sql



def ohlcv() -> list[Column]:
    return [F.col(c) for c in ("open", "high", "low", "close", "volume")]


OHLCV_SQL = "open, high, low, close, volume"


@query("panel_ingest", sql("panel", f"SELECT date::VARCHAR AS date, ticker, {OHLCV_SQL} FROM panel"))
def panel_ingest(i: Inputs) -> DataFrame:
    return src.trades_to_panel(i.table("lineitem")).select(text("date").alias("date"), "ticker", *ohlcv())


@query(
    "date_normalize",
    "SELECT (ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE)::DATE::VARCHAR AS day, count(*) AS n_events FROM events GROUP BY 1",
)
def date_normalize(i: Inputs) -> DataFrame:
    day = src.normalize_date(F.col("ts").cast("timestamp"), "Asia/Kolkata")
    return i.table("events").groupBy(text(day).alias("day")).agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "ingest_manifest",
    sql(
        "dirty",
        """
SELECT coalesce(ticker, 'ALL') AS ticker, count(*) AS n_rows, min(date)::VARCHAR AS min_date, max(date)::VARCHAR AS max_date,
  count(*) - count(open) AS null_open, count(*) - count(high) AS null_high, count(*) - count(low) AS null_low,
  count(*) - count(close) AS null_close, count(*) - count(volume) AS null_volume
FROM dirty GROUP BY ROLLUP (ticker)""",
    ),
)
def ingest_manifest(i: Inputs) -> DataFrame:
    nulls = [
        F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"null_{c}") for c in clean.VALUES
    ]
    return (
        i.dirty.rollup("ticker")
        .agg(F.count(F.lit(1)).alias("n_rows"), text(F.min("date")).alias("min_date"), text(F.max("date")).alias("max_date"), *nulls)
        .withColumn("ticker", F.coalesce("ticker", F.lit("ALL")))
    )


@query(
    "required_columns",
    sql(
        "dirty",
        " UNION ALL ".join(f"SELECT '{c}' AS name, true AS present, count({c}) AS n_values FROM dirty" for c in src.PANEL_COLUMNS)
        + " UNION ALL SELECT 'adjusted_close', false, 0 FROM dirty LIMIT 8",
    ),
)
def required_columns(i: Inputs) -> DataFrame:
    """Columns that cleaning needs, and one that this panel doesn't have."""
    return clean.column_report(i.dirty, (*src.PANEL_COLUMNS, "adjusted_close"))


@query(
    "dual_sink",
    sql(
        "panel",
        f"""
SELECT format, ticker, count(*) AS n_rows, min(date)::VARCHAR AS first_date, round(sum(close), 3) AS close_sum, round(max(high), 3) AS top, sum(volume) AS volume
FROM panel, (VALUES ('csv'), ('parquet')) f(format) GROUP BY ALL""",
    ),
)
def dual_sink(i: Inputs) -> DataFrame:
    """The panel written as Parquet and as CSV, each read back by itself."""
    path = f"{shared_dir(i.spark)}/stages/dual-{uuid.uuid4().hex}"
    src.write_tables(i.panel, path)
    back = {"parquet": i.spark.read.parquet(f"{path}/parquet"), "csv": i.spark.read.schema(i.panel.schema).option("header", True).csv(f"{path}/csv")}
    both = [df.select(F.lit(name).alias("format"), *src.PANEL_COLUMNS) for name, df in back.items()]
    return both[0].unionByName(both[1]).groupBy("format", "ticker").agg(
        F.count(F.lit(1)).alias("n_rows"),
        text(F.min("date")).alias("first_date"),
        F.round(F.sum("close"), 3).alias("close_sum"),
        F.round(F.max("high"), 3).alias("top"),
        F.sum("volume").alias("volume"),
    )


@query(
    "stored_join",
    sql(
        "labelled",
        """
SELECT ticker, split, count(*) AS n_rows, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date, sum(volume) AS volume
FROM labelled WHERE date BETWEEN DATE '1996-05-15' AND DATE '1998-02-10' GROUP BY 1, 2""",
    ),
)
def stored_join(i: Inputs) -> DataFrame:
    """Panel and labels stored in buckets of (date, ticker), joined over a range of dates without an exchange."""
    keys, buckets = ["date", "ticker"], layout.buckets_for(i.panel)
    name = uuid.uuid4().hex
    panel = layout.store(i.panel, f"panel_{name}", keys, buckets)
    labels = layout.store(splits.assign_split(i.panel).select(*keys, "split"), f"labels_{name}", keys, buckets)
    span = ("1996-05-15", "1998-02-10")
    joined = layout.between(panel, *span).join(layout.between(labels, *span).drop("year"), keys)
    return joined.groupBy("ticker", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), text(F.min("date")).alias("first_date"), text(F.max("date")).alias("last_date"), F.sum("volume").alias("volume")
    )


@query(
    "pushdown_scan",
    """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-12-31'
""",
)
def pushdown_scan(i: Inputs) -> DataFrame:
    day = F.col("l_shipdate")
    return (
        i.table("lineitem")
        .where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30.0))
        .where((day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day <= F.lit("1997-12-31").cast("timestamp_ntz")))
        .select("l_orderkey", "l_linenumber", "l_quantity")
    )


@query(
    "dup_key_count",
    """
SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem""",
)
def dup_key_count(i: Inputs) -> DataFrame:
    return clean.duplicate_keys(i.table("lineitem"), ("l_orderkey", "l_linenumber"))


@query("clean_null_drop", sql("dirty", f"SELECT date::VARCHAR AS date, ticker, {OHLCV_SQL} FROM dirty WHERE {FULL}"))
def clean_null_drop(i: Inputs) -> DataFrame:
    return i.dirty.where(clean.all_finite()).select(text("date").alias("date"), "ticker", *ohlcv())


@query("ohlc_tolerance", sql("dirty", f"SELECT date::VARCHAR AS date, ticker, {TOL} AS tolerance FROM dirty WHERE {FULL}"))
def ohlc_tolerance(i: Inputs) -> DataFrame:
    return i.dirty.where(clean.all_finite()).select(
        text("date").alias("date"), "ticker", clean.tolerance().alias("tolerance")
    )


@query("clean_ohlc_filter", sql("valid", f"SELECT date::VARCHAR AS date, ticker, {OHLCV_SQL} FROM valid"))
def clean_ohlc_filter(i: Inputs) -> DataFrame:
    return clean.valid_rows(i.dirty).select(text("date").alias("date"), "ticker", *ohlcv())


CHECKS_SQL = f"""
SELECT count(*) AS rows_in, count(*) FILTER (NOT full_row) AS null_rows,
  count(*) FILTER (full_row AND NOT strict) AS strict_failures,
  count(*) FILTER (full_row AND NOT strict AND loose) AS float_edge_rescued,
  count(*) FILTER (full_row AND NOT loose) AS invariant_drops,
  count(*) FILTER (full_row AND loose) AS valid_rows
FROM (SELECT {FULL} AS full_row, {ok('0')} AS strict, {ok()} AS loose FROM dirty)"""


@query("float_edge_rescue", sql("dirty", f"SELECT strict_failures, float_edge_rescued, invariant_drops FROM ({CHECKS_SQL})"))
def float_edge_rescue(i: Inputs) -> DataFrame:
    return clean.row_checks(i.dirty).select("strict_failures", "float_edge_rescued", "invariant_drops")


@query("ticker_coverage", sql("cover", f"SELECT ticker, n_dates, calendar_dates, {R('coverage', 'coverage')} FROM cover"))
def ticker_coverage(i: Inputs) -> DataFrame:
    return clean.coverage(clean.valid_rows(i.dirty)).withColumn("coverage", r6("coverage"))


@query("clean_panel", sql("cleaned", f"SELECT date::VARCHAR AS date, ticker, {OHLCV_SQL} FROM cleaned"))
def clean_panel(i: Inputs) -> DataFrame:
    return clean.clean_panel(i.dirty).select(text("date").alias("date"), "ticker", *ohlcv())


QUALITY = ["rows_in", "null_rows", "strict_failures", "float_edge_rescued", "invariant_drops", "valid_rows", "low_coverage_tickers"]


@query(
    "quality_report",
    sql(
        "dirty cover",
        f"""
SELECT u.check_name, u.n, CASE WHEN u.check_name IN ('rows_in', 'valid_rows') THEN CASE WHEN u.n > 0 THEN 'PASS' ELSE 'FAIL' END
  WHEN u.n = 0 THEN 'PASS' ELSE 'WARN' END AS status
FROM (UNPIVOT (SELECT *, (SELECT count(*) FROM cover WHERE coverage < 0.96) AS low_coverage_tickers FROM ({CHECKS_SQL}))
  ON {', '.join(QUALITY)} INTO NAME check_name VALUE n) u""",
    ),
)
def quality_report(i: Inputs) -> DataFrame:
    low = clean.coverage(clean.valid_rows(i.dirty)).where(F.col("coverage") < PROTOCOL.min_coverage)
    one = clean.row_checks(i.dirty).withColumn(
        "low_coverage_tickers", low.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    )
    must_have = F.col("check_name").isin("rows_in", "valid_rows")
    status = F.when(F.when(must_have, F.col("n") > 0).otherwise(F.col("n") == 0), "PASS").otherwise(
        F.when(must_have, "FAIL").otherwise("WARN")
    )
    return clean.tall(one, QUALITY, "check_name", "n", "long").withColumn("status", status)


@query(
    "null_profile",
    sql(
        "dirty",
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
            f"{R(f'(count(*) - count({c})) * 100.0::DOUBLE / count(*)', 'pct_null')} FROM dirty"
            for c in src.PANEL_COLUMNS
        ),
    ),
)
def null_profile(i: Inputs) -> DataFrame:
    return clean.null_profile(i.dirty, list(src.PANEL_COLUMNS)).withColumn("pct_null", r6("pct_null"))


@query(
    "zero_volume_fate",
    sql(
        "dirty cover cleaned",
        f"""
SELECT CASE WHEN c.ticker IS NOT NULL THEN 'kept' WHEN d.close IS NULL THEN 'null_price'
  WHEN NOT {ok().replace('high', 'd.high').replace('low ', 'd.low ').replace('open', 'd.open').replace('close', 'd.close').replace('volume', 'd.volume').replace('abs(low)', 'abs(d.low)')} THEN 'invariant'
  WHEN v.coverage < 0.96 THEN 'low_coverage' ELSE 'other' END AS fate, count(*) AS n_rows
FROM dirty d LEFT JOIN cleaned c ON c.date = d.date AND c.ticker = d.ticker LEFT JOIN cover v ON v.ticker = d.ticker
WHERE d.volume = 0 GROUP BY 1""",
    ),
)
def zero_volume_fate(i: Inputs) -> DataFrame:
    return clean.zero_volume_fate(i.dirty)


RULES_SQL = """high >= low AS a, high >= open AS b, high >= close AS c, low <= open AS d, low <= close AS e, volume >= 0 AS f"""


@query(
    "ohlc_violations",
    sql(
        "dirty",
        f"""
SELECT date::VARCHAR AS date, ticker, NOT a AS fail_h_ge_l, NOT b AS fail_h_ge_o, NOT c AS fail_h_ge_c,
  NOT d AS fail_l_le_o, NOT e AS fail_l_le_c, NOT f AS fail_v_ge_0
FROM (SELECT date, ticker, {RULES_SQL} FROM dirty WHERE close IS NOT NULL)
WHERE NOT (a AND b AND c AND d AND e AND f)""",
    ),
)
def ohlc_violations(i: Inputs) -> DataFrame:
    return clean.violations(i.dirty, strict=True).withColumn("date", text("date"))


@query(
    "violation_antijoin",
    sql(
        "dirty cleaned",
        f"""
SELECT count(*) AS n_violations, count(c.ticker) AS still_in_clean
FROM (SELECT * FROM dirty WHERE close IS NOT NULL AND NOT {ok()}) d
LEFT JOIN cleaned c ON c.date = d.date AND c.ticker = d.ticker""",
    ),
)
def violation_antijoin(i: Inputs) -> DataFrame:
    broken = clean.violations(i.dirty).select("date", "ticker")
    kept = clean.clean_panel(i.dirty).select("date", "ticker", F.lit(1).alias("__kept"))
    return broken.join(kept, ["date", "ticker"], "left").agg(
        F.count(F.lit(1)).alias("n_violations"), F.count("__kept").alias("still_in_clean")
    )


def _panel_metrics(df: DataFrame) -> DataFrame:
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("date").alias("n_dates"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.sum("volume").alias("volume"),
    )
    return clean.tall(one, ["n_rows", "n_dates", "n_tickers", "volume"], "metric", "value")


METRICS_SQL = "SELECT count(*)::DOUBLE AS n_rows, count(DISTINCT date)::DOUBLE AS n_dates, count(DISTINCT ticker)::DOUBLE AS n_tickers, sum(volume) AS volume FROM {}"


@query(
    "clean_reconcile",
    sql(
        "panel cleaned",
        f"""
SELECT coalesce(a.metric, b.metric) AS metric, {R('a.value', 'expected')}, {R('b.value', 'observed')},
  coalesce(a.value = b.value, false) AS matches,
  CASE WHEN bool_and(coalesce(a.value = b.value, false)) OVER () THEN 'PASS' ELSE 'FAIL' END AS overall
FROM (UNPIVOT ({METRICS_SQL.format('panel')}) ON n_rows, n_dates, n_tickers, volume INTO NAME metric VALUE value) a
FULL JOIN (UNPIVOT ({METRICS_SQL.format('cleaned')}) ON n_rows, n_dates, n_tickers, volume INTO NAME metric VALUE value) b
  ON a.metric = b.metric""",
    ),
)
def clean_reconcile(i: Inputs) -> DataFrame:
    both = clean.reconcile(
        _panel_metrics(i.panel), _panel_metrics(clean.clean_panel(i.dirty)), "metric", "value"
    )
    every = both.agg(F.bool_and("matches").alias("m")).select("m").scalar()
    return both.select(
        "metric", r6("expected").alias("expected"), r6("observed").alias("observed"), "matches",
        F.when(every, "PASS").otherwise("FAIL").alias("overall"),
    )


@query(
    "coverage_reconcile",
    sql(
        "panel cover",
        f"""
SELECT ticker, {R('a.coverage', 'expected')}, {R('b.coverage', 'observed')}, abs(a.coverage - b.coverage) <= 1e-9 AS matches,
  b.coverage >= 0.96 AS above_threshold
FROM (SELECT ticker, count(DISTINCT date)::DOUBLE / (SELECT count(DISTINCT date) FROM panel) AS coverage FROM panel GROUP BY ticker) a
FULL JOIN cover b USING (ticker)""",
    ),
)
def coverage_reconcile(i: Inputs) -> DataFrame:
    both = clean.reconcile(
        clean.coverage(i.panel), clean.coverage(clean.valid_rows(i.dirty)), "ticker", "coverage", 1e-9
    )
    return both.select(
        "ticker", r6("expected").alias("expected"), r6("observed").alias("observed"), "matches",
        (F.col("observed") >= PROTOCOL.min_coverage).alias("above_threshold"),
    )


@query(
    "domain_guard",
    sql(
        "panel blocks",
        """
SELECT b.feature_block, p.ticker, count(*) AS n_rows, count(*) FILTER (high <= 0 OR low <= 0 OR close <= 0) AS non_positive_price,
  count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (NOT (isfinite(close) AND isfinite(volume))) AS non_finite
FROM panel p JOIN blocks b ON (p.ticker = 'T0') = b.is_target AND p.date BETWEEN b.lo AND b.hi GROUP BY 1, 2""",
    ),
)
def domain_guard(i: Inputs) -> DataFrame:
    return clean.domain_guard(splits.feature_blocks(i.panel), ["feature_block", "ticker"])


@query("split_assign", sql("labelled", "SELECT date::VARCHAR AS date, ticker, split FROM labelled"))
def split_assign(i: Inputs) -> DataFrame:
    return splits.assign_split(i.panel).select(text("date").alias("date"), "ticker", "split")


@query(
    "split_overlap",
    sql(
        "panel splits",
        """
SELECT n_rules::BIGINT AS n_rules, count(*) AS n_rows FROM (
  SELECT p.date, p.ticker, count(s.split) AS n_rules FROM panel p
  LEFT JOIN splits s ON (p.ticker = 'T0') = s.is_target AND p.date BETWEEN s.lo AND s.hi GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def split_overlap(i: Inputs) -> DataFrame:
    return splits.split_overlaps(i.panel).withColumn("n_rules", F.col("n_rules").cast("long"))


@query(
    "daily_row",
    sql(
        "labelled",
        "SELECT date::VARCHAR AS date, ticker, row_number() OVER (ORDER BY date, ticker) - 1 AS daily_row, split FROM labelled",
    ),
)
def daily_row(i: Inputs) -> DataFrame:
    return splits.with_daily_row(splits.assign_split(i.panel)).select(
        text("date").alias("date"), "ticker", "daily_row", "split"
    )


@query(
    "split_report",
    sql(
        "labelled splits",
        """
SELECT l.label_order, l.split, count(p.ticker) AS n_rows, min(p.date)::VARCHAR AS min_date, max(p.date)::VARCHAR AS max_date,
  count(DISTINCT p.ticker) AS n_tickers
FROM (SELECT label_order, split FROM splits UNION ALL SELECT 5, 'unused') l LEFT JOIN labelled p USING (split) GROUP BY 1, 2""",
    ),
)
def split_report(i: Inputs) -> DataFrame:
    return splits.split_report(splits.assign_split(i.panel)).select(
        "label_order", "split", "n_rows", text("min_date").alias("min_date"), text("max_date").alias("max_date"), "n_tickers"
    )


@query(
    "split_assertions",
    sql(
        "panel splits",
        """
SELECT bool_and(n_rules >= 0) AS exhaustive, count(*) = count(DISTINCT (date, ticker)) AS unique_key,
  max(n_rules) <= 1 AS exclusive, count(*) AS n_rows
FROM (SELECT p.date, p.ticker, (SELECT count(*) FROM splits s WHERE (p.ticker = 'T0') = s.is_target AND p.date BETWEEN s.lo AND s.hi) AS n_rules FROM panel p)""",
    ),
)
def split_assertions(i: Inputs) -> DataFrame:
    return splits.split_assertions(i.panel)


@query(
    "join_one_to_one",
    sql(
        "panel labelled",
        """
SELECT (SELECT count(*) FROM panel) AS left_rows, (SELECT count(*) FROM labelled) AS right_rows,
  (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY date, ticker HAVING count(*) > 1)) AS left_duplicate_keys,
  (SELECT count(*) FROM (SELECT 1 FROM labelled GROUP BY date, ticker HAVING count(*) > 1)) AS right_duplicate_keys,
  (SELECT count(*) FROM panel p ANTI JOIN labelled l ON p.date = l.date AND p.ticker = l.ticker) AS left_only,
  (SELECT count(*) FROM labelled l ANTI JOIN panel p ON p.date = l.date AND p.ticker = l.ticker) AS right_only,
  (SELECT count(*) FROM panel JOIN labelled USING (date, ticker)) AS joined_rows""",
    ),
)
def join_one_to_one(i: Inputs) -> DataFrame:
    labels = splits.assign_split(i.panel).select("date", "ticker", "split")
    return splits.join_one_to_one(i.panel, labels, ["date", "ticker"])[1]


@query(
    "feature_blocks",
    sql("blocked", "SELECT feature_block, date::VARCHAR AS date, ticker, close FROM blocked"),
)
def feature_blocks(i: Inputs) -> DataFrame:
    return splits.feature_blocks(i.panel).select("feature_block", text("date").alias("date"), "ticker", "close")


@query(
    "visible_leak_guard",
    sql(
        "feat",
        """
SELECT count(*) AS n_rows, count(*) FILTER (feature_block <> 'visible') AS wrong_block, count(*) FILTER (ticker <> 'T0') AS wrong_ticker,
  count(*) FILTER (date < DATE '2000-07-01') AS before_start, count(*) FILTER (date > DATE '2000-12-31') AS after_end,
  count(*) - count(DISTINCT (date, ticker)) AS repeated_days, 0::BIGINT AS non_finite
FROM feat WHERE ticker = 'T0'""",
    ),
)
def visible_leak_guard(i: Inputs) -> DataFrame:
    return splits.visible_leak_guard(i.features.where(F.col("ticker") == PROTOCOL.target))


@query(
    "log_return",
    sql(
        "panel",
        f"""SELECT date::VARCHAR AS date, ticker, {R('ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date))', 'log_return')} FROM panel""",
    ),
)
def log_return(i: Inputs) -> DataFrame:
    return features.with_log_return(i.panel, ["ticker"]).select(
        text("date").alias("date"), "ticker", r6("log_return").alias("log_return")
    )


@query(
    "daily_features",
    sql(
        "feat",
        f"SELECT feature_block, date::VARCHAR AS date, ticker, {R('log_return', 'log_return')}, "
        f"{R('log_high_low_range', 'log_high_low_range')}, {R('log1p_volume', 'log1p_volume')} FROM feat",
    ),
)
def daily_features(i: Inputs) -> DataFrame:
    return features.daily_features(splits.feature_blocks(i.panel)).select(
        "feature_block", text("date").alias("date"), "ticker", *[r6(c).alias(c) for c in PROTOCOL.channels]
    )
