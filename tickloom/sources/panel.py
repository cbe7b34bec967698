"""Readers that give the long OHLCV panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small, stage

PANEL_COLUMNS = ("date", "ticker", "open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades_to_panel(lineitem: DataFrame, n_tickers: int = 5) -> DataFrame:
    """Daily OHLCV bars from trade-like rows, one per (date, ticker).

    First and last trade follow the full row key because order and line number
    alone repeat. A buffer that holds such a key would make Spark sort all trades, so the
    edges of the order number come first, from numbers that it hashes; only trades at an
    edge are compared by their full keys. All aggregates combine on the map side.
    """
    by = ["date", "part"]
    key = F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    trades = lineitem.select(
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_suppkey") % n_tickers).alias("part"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        # Null order numbers are the first, as they are inside a key.
        F.coalesce(F.col("l_orderkey").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("place"),
        key.alias("key"),
    )
    bars = stage(
        trades.groupBy(*by).agg(
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum("quantity").alias("volume"),
            F.min("place").alias("first"),
            F.max("place").alias("last"),
        ),
        "bars",
    )
    edges = broadcast_if_small(bars.select(F.col("date").alias("__date"), F.col("part").alias("__part"), "first", "last"))
    same = F.col("date").eqNullSafe(F.col("__date")) & F.col("part").eqNullSafe(F.col("__part"))
    at_edge = trades.join(edges, same & ((F.col("place") == F.col("first")) | (F.col("place") == F.col("last"))))
    ends = at_edge.groupBy(*by).agg(F.min_by("price", "key").alias("open"), F.max_by("price", "key").alias("close"))
    same = F.col("date").eqNullSafe(F.col("__date")) & F.col("part").eqNullSafe(F.col("__part"))
    ends = ends.select(F.col("date").alias("__date"), F.col("part").alias("__part"), "open", "close")
    ticker = F.concat(F.lit("T"), F.col("part").cast("string")).alias("ticker")
    return bars.join(ends, same).select("date", ticker, "open", "high", "low", "close", "volume")


def read_ticker_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Panel from one parquet file or folder per ticker (``ticker=<name>``)."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    missing = [c for c in PANEL_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"panel files miss columns {missing}")
    return df.select(*PANEL_COLUMNS)


def write_ticker_files(panel: DataFrame, path: str) -> None:
    """One folder per ticker; files split by year so a hot ticker is not one task."""
    by_year = panel.withColumn("__year", F.year("date"))
    by_year.repartition("ticker", "__year").drop("__year").write.partitionBy("ticker").parquet(path)


def write_tables(df: DataFrame, path: str) -> None:
    """The same rows as parquet and as CSV with 12 significant digits."""
    df.write.parquet(f"{path}/parquet")
    text = [
        F.format_string("%.12g", F.col(f.name)).alias(f.name)
        if f.dataType.typeName() in ("double", "float")
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*text).write.option("header", True).csv(f"{path}/csv")


def normalize_date(col: Column, zone: str = "UTC") -> Column:
    """Local wall-clock time of ``zone`` to the UTC calendar date."""
    return F.to_date(F.to_utc_timestamp(col, zone))
