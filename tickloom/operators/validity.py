"""Physical validity of calibrated windows and accept/reject pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from ..functions.arrays import channel, finite
from ..session import stage
from .sequence import with_position

REASONS = (
    "non_finite_return",
    "non_finite_range",
    "negative_range",
    "non_finite_volume",
    "invalid_volume",
    "other",
)


def is_valid(flat: Column) -> Column:
    """Whole window is valid: finite everywhere, range and volume not negative."""
    return (
        F.forall(flat, finite)
        & F.forall(channel(flat, 1), lambda x: x >= 0)
        & F.forall(channel(flat, 2), lambda x: x >= 0)
    )


def reject_reason(flat: Column) -> Column:
    """First failing reason in the fixed order; null when the window is accepted."""
    ranges, volumes = channel(flat, 1), channel(flat, 2)
    return (
        F.when(~F.forall(channel(flat, 0), finite), REASONS[0])
        .when(~F.forall(ranges, finite), REASONS[1])
        .when(F.exists(ranges, lambda x: x < 0), REASONS[2])
        .when(~F.forall(volumes, lambda x: finite(x) & finite(F.expm1(x))), REASONS[3])
        .when(F.exists(volumes, lambda x: F.expm1(x) < 0), REASONS[4])
    )


def validity_summary(pool: DataFrame, keys: list[str], flat: str) -> DataFrame:
    return (
        pool.withColumn("__ok", is_valid(F.col(flat)).cast("int"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("generated"),
            F.sum("__ok").alias("valid"),
            F.sum(1 - F.col("__ok")).alias("invalid"),
            F.avg(1.0 - F.col("__ok")).alias("invalid_rate"),
        )
    )


def reason_counts(pool: DataFrame, keys: list[str], flat: str) -> DataFrame:
    """Rejections per reason; reasons that never happened count zero."""
    one = pool.withColumn("__why", reject_reason(F.col(flat))).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("__why") == r, 1).otherwise(0)).alias(r) for r in REASONS]
    )
    cells = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n_windows")) for r in REASONS])
    return one.select(*keys, F.explode(cells).alias("__c")).select(*keys, "__c.*")


def accept_first(candidates: DataFrame, keys: list[str], row_id: str, ok: Column, n: int, bucket_rows: int = 65536) -> DataFrame:
    """First ``n`` accepted candidates per key in id order, with running accounting.

    ``candidate_no`` is the 1-based draw number, so for the last accepted row it is
    the number of candidates spent.
    """
    accepted = with_position(
        candidates.where(ok), keys, [F.col(row_id)], [F.floor(F.col(row_id) / bucket_rows)], "accepted_no"
    )
    return accepted.where(F.col("accepted_no") < n).withColumn("candidate_no", F.col(row_id) + 1)


def accept_reject(draw, keys: list[str], row_id: str, ok: Column, n: int, max_rounds: int = 12) -> DataFrame:
    """Draw, reject and top up until every key holds ``n`` accepted windows.

    ``draw(lo, hi)`` gives the candidates of every key with ids in [lo, hi). Each round
    is written once and sized by the lowest acceptance so far. Only the number of
    accepted rows of the poorest key reaches the driver. Too few is an error, not a cut.
    """
    drawn, lo, hi = None, 0, n + max(16, n // 8)
    for _ in range(max_rounds):
        fresh = stage(draw(lo, hi), "candidates")
        drawn = fresh if drawn is None else drawn.unionByName(fresh)
        per_key = drawn.groupBy(*keys).agg(F.sum(ok.cast("int")).alias("n_ok"))
        accepted = per_key.agg(F.min("n_ok")).first()[0] or 0
        if accepted >= n:
            return accept_first(drawn, keys, row_id, ok, n)
        rate = max(accepted / hi, 0.01)
        lo, hi = hi, hi + int(1.1 * (n - accepted) / rate) + 16
    raise RuntimeError(f"only {accepted} of {n} windows accepted after {lo} candidates")


def window_minima(flat: Column) -> tuple[Column, Column]:
    """Smallest range and smallest log volume of a window."""
    return F.array_min(channel(flat, 1)), F.array_min(channel(flat, 2))


def residual_validity(pool: DataFrame, keys: list[str], flat: str) -> DataFrame:
    low_range, low_volume = window_minima(F.col(flat))
    return pool.groupBy(*keys).agg(
        F.bool_and(F.forall(F.col(flat), finite)).alias("all_finite"),
        F.min(low_range).alias("min_range"),
        F.min(low_volume).alias("min_log1p_volume"),
        F.min(F.expm1(low_volume)).alias("min_expm1_volume"),
        F.sum((~is_valid(F.col(flat))).cast("int")).alias("invalid_left"),
    )
