"""Channel normalizers, target calibration and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from .windows import sessions, unpivot_channels

ZERO_STD = 1e-8


def channel_stats(steps: DataFrame, keys: list[str], proto: Protocol = PROTOCOL) -> DataFrame:
    """Population mean and std per channel in long form.

    A std under 1e-8 scales by one; ``raw_std`` keeps the measured value.
    """
    wide = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("raw_std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c)
            for c in proto.channels
        ],
    )
    long = unpivot_channels(wide, [*keys, "n"], proto)
    return long.select(*keys, "channel", "n", "value.mean", "value.raw_std", "value.min", "value.max").withColumn(
        "std", F.when(F.col("raw_std") < ZERO_STD, 1.0).otherwise(F.col("raw_std"))
    )


def scaler_row(steps: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """One row ``(mu, sd)`` of channel arrays, ready for a scalar subquery."""
    sds = [F.stddev_pop(c) for c in proto.channels]
    return steps.agg(
        F.struct(
            F.array(*[F.avg(c) for c in proto.channels]).alias("mu"),
            F.array(*[F.when(s < ZERO_STD, 1.0).otherwise(s) for s in sds]).alias("sd"),
        ).alias("scaler")
    )


def fit_normalizer(windows: DataFrame, proto: Protocol = PROTOCOL) -> Column:
    """Scaler of the given windows as a scalar column; validation data never enters."""
    return scaler_row(sessions(windows, [], proto), proto).select("scaler").scalar()


def _per_channel(df: DataFrame, scaler: Column, source: str, out: str, fn, proto: Protocol) -> DataFrame:
    """Apply ``fn(x, mu, sd)`` to each value; the one-row scaler is attached first
    because a subquery may not sit inside an array lambda."""
    n = len(proto.channels)
    mu, sd = F.col("__scaler")["mu"], F.col("__scaler")["sd"]
    mapped = F.transform(source, lambda x, i: fn(x, F.get(mu, i % n), F.get(sd, i % n)))
    return df.withColumn("__scaler", scaler).withColumn(out, mapped).drop("__scaler")


def normalize(
    df: DataFrame, scaler: Column, source: str = "features_flat", out: str | None = None, proto: Protocol = PROTOCOL
) -> DataFrame:
    """(x - mu) / sd per channel."""
    return _per_channel(df, scaler, source, out or source, lambda x, mu, sd: (x - mu) / sd, proto)


def denormalize(
    df: DataFrame, scaler: Column, source: str = "features_flat", out: str | None = None, proto: Protocol = PROTOCOL
) -> DataFrame:
    """mu + sd * z per channel: the way back, or calibration to a target. No clipping."""
    return _per_channel(df, scaler, source, out or source, lambda z, mu, sd: mu + sd * z, proto)


def to_exchange(flat: Column) -> Column:
    """The float32 exchange form of a normalized window, read back as doubles."""
    return F.transform(flat, lambda x: x.cast("float").cast("double"))


def provenance(observed: DataFrame, declared: DataFrame, verified: Column, tol: float = 1e-6) -> DataFrame:
    """Status per producer: verified, mismatch, numerically equal or not verifiable.

    ``declared`` holds (producer, channel, mean, std); ``observed`` (channel, mean, std).
    """
    joined = declared.join(
        observed.select("channel", F.col("mean").alias("o_mean"), F.col("std").alias("o_std")), "channel", "left"
    )
    close = (F.abs(F.col("mean") - F.col("o_mean")) <= tol) & (F.abs(F.col("std") - F.col("o_std")) <= tol)
    per = joined.withColumn("__verified", verified).groupBy("producer").agg(
        F.bool_or("__verified").alias("hash_ok"),
        F.count("mean").alias("n_declared"),
        F.bool_and(F.coalesce(close, F.lit(False))).alias("all_close"),
    )
    status = (
        F.when(F.col("hash_ok"), "verified")
        .when((F.col("n_declared") > 0) & ~F.col("all_close"), "mismatch")
        .when(F.col("n_declared") > 0, "numerically_matches")
        .otherwise("not_verifiable")
    )
    return per.select("producer", status.alias("status"))
