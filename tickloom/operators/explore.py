"""Exploration of the long panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import small, stage
from .correlate import tickers_in_order, wide_blocks
from .sequence import quantiles


def overview(panel: DataFrame) -> DataFrame:
    """Days per ticker beside the size and span of the whole panel."""
    whole = panel.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("days")
        ).alias("w")
    ).select("w").scalar()
    per = panel.groupBy("ticker").agg(
        F.countDistinct("date").alias("n_days"), F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
    ).withColumn("__w", whole)
    return per.select(
        *per.columns[:-1], F.col("__w.rows").alias("panel_rows"), F.col("__w.tickers").alias("n_tickers"), F.col("__w.days").alias("union_days")
    )


def calendar_gaps(panel: DataFrame) -> DataFrame:
    """Sessions of the union calendar that each ticker lacks, most first."""
    calendar = panel.agg(F.countDistinct("date").alias("n")).select("n").scalar()
    per = panel.groupBy("ticker").agg(F.countDistinct("date").alias("n_days")).withColumn("__all", calendar)
    return per.select("ticker", (F.col("__all") - F.col("n_days")).alias("missing_sessions")).orderBy(
        F.desc("missing_sessions"), "ticker"
    )


def wide(panel: DataFrame, value: str, tickers: list[str]) -> DataFrame:
    """One row per date, one column per named ticker, read off blocks of arrays."""
    order = stage(tickers_in_order(panel.where(F.col("ticker").isin(*tickers)), value), "tickers")
    at = {r.ticker: (r.block, r.slot) for r in order.collect()}  # the named tickers, which become columns
    blocks = wide_blocks(panel, value, order)
    cells = [F.max(F.when(F.col("block") == at[t][0], F.get("values", F.lit(at[t][1])))) if t in at else F.max(F.lit(None).cast("double")) for t in tickers]
    found = blocks.groupBy("date").agg(*[c.alias(t) for c, t in zip(cells, tickers)])
    return panel.select("date").distinct().join(found, "date", "left")


def daily_volume(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(
        F.sum("volume").alias("volume"), F.sum((F.col("volume") == 0).cast("int")).alias("zero_volume_rows")
    )


def return_stats(returns: DataFrame, keys: list[str], value: str = "log_return") -> DataFrame:
    """Sample std, and skew and excess kurtosis corrected for bias."""
    n = F.col("n")
    stats = returns.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"),
    )
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.col("g2") + 6.0))
    return stats.withColumn("skew", skew).withColumn("kurtosis", kurt).drop("g1", "g2")


def large_moves(returns: DataFrame, threshold: float, n: int) -> DataFrame:
    big = returns.where(F.abs("log_return") > threshold)
    return big.orderBy(F.abs("log_return").desc(), "date", "ticker").limit(n)


def range_stats(panel: DataFrame) -> DataFrame:
    shaped = panel.select(
        "ticker", ((F.col("high") - F.col("low")) / F.col("close")).alias("hl_over_c"), F.log(F.col("high") / F.col("low")).alias("ln_hl")
    )
    stats = shaped.groupBy("ticker").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("hl_over_c", "ln_hl") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    )
    for c in ("hl_over_c", "ln_hl"):
        stats = stats.join(quantiles(shaped, ["ticker"], c, {f"{c}_median": 0.5}), "ticker")
    return stats


def drilldown(panel: DataFrame, returns: DataFrame, ticker: str) -> DataFrame:
    prices = panel.where(F.col("ticker") == ticker).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"),
    )
    return prices.join(return_stats(returns.where(F.col("ticker") == ticker), ["ticker"]), "ticker")


def box_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, the furthest points within 1.5 IQR, and how many lie beyond."""
    box = quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    x = F.col(value)
    return rows.join(small(box, "box"), keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(x >= low, x)).alias("whisker_low"),
        F.max(F.when(x <= high, x)).alias("whisker_high"),
        F.sum(((x < low) | (x > high)).cast("int")).alias("n_outliers"),
    )
