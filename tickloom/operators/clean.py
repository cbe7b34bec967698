"""Cleaning rules, coverage and data-quality reports for the OHLCV panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from ..functions.arrays import finite
from ..session import small

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")


def require_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def column_report(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(name, present, n_values) of each required column; an absent one has no value."""
    cells = [
        F.struct(F.lit(n).alias("name"), F.lit(n in df.columns).alias("present"), (F.count(n) if n in df.columns else F.sum(F.lit(0))).alias("n_values"))
        for n in names
    ]
    one = df.agg(*[c.alias(f"c{k}") for k, c in enumerate(cells)])
    long = one.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(names))])).alias("c")).select("c.*")
    return long.withColumn("n_values", F.coalesce("n_values", F.lit(0)))


def all_finite(names: tuple[str, ...] = VALUES) -> Column:
    ok = F.lit(True)
    for name in names:
        ok = ok & F.col(name).isNotNull() & ~F.isnan(name)
    return ok


def tolerance(proto: Protocol = PROTOCOL, scale: float = 1.0) -> Column:
    """Absolute plus relative slack of one row; ``scale=0`` gives the strict rule."""
    biggest = F.greatest(*[F.abs(F.col(c)) for c in PRICES])
    return F.lit(scale) * (F.lit(proto.abs_tolerance) + F.lit(proto.rel_tolerance) * biggest)


RULES = {
    "fail_h_ge_l": lambda tol: ~(F.col("high") + tol >= F.col("low")),
    "fail_h_ge_o": lambda tol: ~(F.col("high") + tol >= F.col("open")),
    "fail_h_ge_c": lambda tol: ~(F.col("high") + tol >= F.col("close")),
    "fail_l_le_o": lambda tol: ~(F.col("low") - tol <= F.col("open")),
    "fail_l_le_c": lambda tol: ~(F.col("low") - tol <= F.col("close")),
    "fail_v_ge_0": lambda tol: ~(F.col("volume") >= 0),
}


def invariant(tol: Column) -> Column:
    """True when high and low bound the other prices and volume is not negative."""
    broken = F.lit(False)
    for rule in RULES.values():
        broken = broken | rule(tol)
    return ~broken


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: surplus rows beyond the first of each natural key."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def valid_rows(panel: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    return panel.where(all_finite()).where(invariant(tolerance(proto)))


def coverage(valid: DataFrame) -> DataFrame:
    """Share of the union calendar that each ticker covers.

    The calendar is that of all tickers, before any of them is dropped.
    """
    per_ticker = valid.groupBy("ticker").agg(F.countDistinct("date").alias("n_dates"))
    calendar = valid.agg(F.countDistinct("date").alias("n")).select("n").scalar()
    return per_ticker.withColumn("calendar_dates", calendar).withColumn(
        "coverage", F.col("n_dates") / F.col("calendar_dates")
    )


def drop_low_coverage(valid: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    dropped = coverage(valid).where(F.col("coverage") < proto.min_coverage).select("ticker")
    return valid.join(small(dropped, "dropped"), "ticker", "left_anti").select(*valid.columns)


def clean_panel(panel: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Null drop, tolerant price invariants, then the coverage rule."""
    return drop_low_coverage(valid_rows(panel, proto), proto)


def row_checks(panel: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """One row of cleaning counts over the raw panel."""
    complete = all_finite()
    strict = invariant(tolerance(proto, 0.0))
    loose = invariant(tolerance(proto))

    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))

    return panel.agg(
        F.count(F.lit(1)).alias("rows_in"),
        n(~complete).alias("null_rows"),
        n(complete & ~strict).alias("strict_failures"),
        n(complete & ~strict & loose).alias("float_edge_rescued"),
        n(complete & ~loose).alias("invariant_drops"),
        n(complete & loose).alias("valid_rows"),
    )


def tall(row: DataFrame, names: list[str], key: str, value: str, cast: str = "double") -> DataFrame:
    """Turn the columns of a one-row (or few-row) table into (name, value) rows."""
    cells = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).cast(cast).alias(value)) for n in names])
    others = [c for c in row.columns if c not in names]
    return row.select(*others, F.explode(cells).alias("__cell")).select(*others, "__cell.*")


def null_profile(df: DataFrame, names: list[str]) -> DataFrame:
    one = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in names],
    )
    long = tall(one, names, "column_name", "n_null", "long")
    return long.select(
        "column_name", "n_null", (F.col("n_null") * 100.0 / F.col("__rows")).alias("pct_null")
    )


def zero_volume_fate(panel: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """What became of each zero-volume row, counted per fate.

    Zero volume alone never drops a row.
    """
    kept = clean_panel(panel, proto).select("date", "ticker", F.lit(True).alias("__kept"))
    low = (
        coverage(valid_rows(panel, proto))
        .where(F.col("coverage") < proto.min_coverage)
        .select("ticker", F.lit(True).alias("__low"))
    )
    low = small(low, "low")
    zero = panel.where(F.col("volume") == 0).join(kept, ["date", "ticker"], "left").join(low, "ticker", "left")
    fate = (
        F.when(F.col("__kept"), "kept")
        .when(~all_finite(PRICES), "null_price")
        .when(~invariant(tolerance(proto)), "invariant")
        .when(F.col("__low"), "low_coverage")
        .otherwise("other")
    )
    return zero.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n_rows"))


def violations(panel: DataFrame, proto: Protocol = PROTOCOL, strict: bool = False) -> DataFrame:
    """Rows that break a price rule, with one flag per rule."""
    tol = tolerance(proto, 0.0 if strict else 1.0)
    rows = panel.where(all_finite(PRICES)).where(~invariant(tol))
    return rows.select("date", "ticker", *[rule(tol).alias(name) for name, rule in RULES.items()])


def reconcile(expected: DataFrame, observed: DataFrame, key: str, value: str, tol: float = 0.0) -> DataFrame:
    """Full comparison of two (key, value) tables with a match flag."""
    left = expected.select(key, F.col(value).cast("double").alias("expected"))
    right = observed.select(key, F.col(value).cast("double").alias("observed"))
    joined = left.join(right, key, "full_outer")
    close = F.abs(F.col("expected") - F.col("observed")) <= F.lit(tol)
    return joined.withColumn("matches", F.coalesce(close, F.lit(False)))


def domain_guard(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per group outside the domain of the logarithms."""
    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    price_bad = (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        n(price_bad).alias("non_positive_price"),
        n(F.col("volume") < 0).alias("negative_volume"),
        n(~(finite(F.col("close")) & finite(F.col("volume")))).alias("non_finite"),
    )
