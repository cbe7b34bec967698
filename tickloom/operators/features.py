"""Daily log channels per feature block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from ..functions.arrays import finite
from .sequence import with_previous


def with_log_return(rows: DataFrame, keys: list[str]) -> DataFrame:
    """ln(close / previous close) inside each key; null for the first row."""
    lagged = with_previous(rows, keys, "date", [F.year("date")], "close", "prev_close")
    usable = (F.col("prev_close") > 0) & (F.col("close") > 0)
    return lagged.withColumn("log_return", F.when(usable, F.log(F.col("close") / F.col("prev_close"))))


def daily_features(blocks: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Three finite log channels per (block, ticker, date).

    The lag restarts at every block edge, so nothing crosses into a block.
    """
    keys = ["feature_block", "ticker"]
    shaped = with_log_return(blocks, keys).select(
        "feature_block",
        "date",
        "ticker",
        "log_return",
        F.when((F.col("high") > 0) & (F.col("low") > 0), F.log(F.col("high") / F.col("low"))).alias(
            "log_high_low_range"
        ),
        F.when(F.col("volume") >= 0, F.log1p("volume")).alias("log1p_volume"),
    )
    return shaped.where(reduce(lambda a, b: a & b, [finite(F.col(c)) for c in proto.channels]))
