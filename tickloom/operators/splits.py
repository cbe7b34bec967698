"""Temporal roles, feature blocks and integrity joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL, DateRule, Protocol
from .sequence import with_range_position

UNUSED = "unused"


def rule_matches(rule: DateRule, proto: Protocol = PROTOCOL) -> Column:
    is_target = F.col("ticker") == proto.target
    role = is_target if rule.role == "target" else ~is_target
    day = F.col("date")
    return role & (day >= F.lit(rule.start).cast("date")) & (day <= F.lit(rule.end).cast("date"))


def matching_rules(rules: tuple[DateRule, ...], proto: Protocol = PROTOCOL) -> Column:
    """Names of the rules that hold for a row.

    The rules are a handful of constants, so they are an expression, not a join.
    """
    flags = F.array(*[F.when(rule_matches(r, proto), r.name) for r in rules])
    return F.filter(flags, lambda name: name.isNotNull())


def assign_split(panel: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    matched = matching_rules(proto.splits, proto)
    return panel.withColumn("split", F.coalesce(F.get(matched, F.lit(0)), F.lit(UNUSED)))


def split_overlaps(panel: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """How many rows match 0, 1 or more exclusive rules."""
    n = F.size(matching_rules(proto.splits, proto))
    return panel.groupBy(n.alias("n_rules")).agg(F.count(F.lit(1)).alias("n_rows"))


def feature_blocks(panel: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """One copy of a row per block it belongs to; rows in no block are left out."""
    return panel.select(
        F.explode(matching_rules(proto.blocks, proto)).alias("feature_block"), *panel.columns
    )


def with_daily_row(panel: DataFrame) -> DataFrame:
    """Row number in (date, ticker) order, without a one-task sort."""
    return with_range_position(panel, ["date", "ticker"], "daily_row")


def split_report(labelled: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Rows, dates and tickers per label; labels without rows are kept."""
    labels = [rule.name for rule in proto.splits] + [UNUSED]
    order = labelled.sparkSession.createDataFrame(
        [(i, name) for i, name in enumerate(labels)], "label_order int, split string"
    )
    stats = labelled.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.countDistinct("ticker").alias("n_tickers"),
    )
    return order.join(stats, "split", "left").fillna(0, ["n_rows", "n_tickers"])


def split_assertions(panel: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Exhaustive, unique and exclusive flags in one row."""
    labels = [rule.name for rule in proto.splits] + [UNUSED]
    labelled = assign_split(panel, proto).withColumn(
        "__rules", F.size(matching_rules(proto.splits, proto))
    )
    per_key = labelled.groupBy("date", "ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("__rules").alias("rules"),
        F.bool_and(F.col("split").isin(labels)).alias("known"),
    )
    return per_key.agg(
        F.bool_and("known").alias("exhaustive"),
        (F.max("n") == 1).alias("unique_key"),
        (F.max("rules") <= 1).alias("exclusive"),
        F.sum("n").alias("n_rows"),
    )


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inner join plus a one-row report that proves both sides unique and whole."""
    joined = left.join(right, keys, "inner")
    # Sides stored in buckets of the keys are counted and met where they are.
    l, r = (side.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "__l"), (right, "__r")))
    per_key = l.join(r, keys, "full_outer").select(F.coalesce("__l", F.lit(0)).alias("l"), F.coalesce("__r", F.lit(0)).alias("r"))
    report = per_key.agg(
        F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"),
        F.sum(F.when(F.col("l") > 1, 1).otherwise(0)).alias("left_duplicate_keys"),
        F.sum(F.when(F.col("r") > 1, 1).otherwise(0)).alias("right_duplicate_keys"),
        F.sum(F.when(F.col("r") == 0, 1).otherwise(0)).alias("left_only"),
        F.sum(F.when(F.col("l") == 0, 1).otherwise(0)).alias("right_only"),
        F.sum(F.col("l") * F.col("r")).alias("joined_rows"),
    )
    return joined, report


def visible_leak_guard(features: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """One row of violation counts for the frame that calibration may see."""
    rule = proto.block("visible")
    bad = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    finite_all = reduce(
        lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in proto.channels]
    )
    per_key = features.groupBy("date", "ticker").agg(
        F.count(F.lit(1)).alias("n"),
        bad(F.col("feature_block") != rule.name).alias("wrong_block"),
        bad(~finite_all).alias("non_finite"),
    )
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.sum("wrong_block").alias("wrong_block"),
        F.sum(F.when(F.col("ticker") != proto.target, F.col("n")).otherwise(0)).alias("wrong_ticker"),
        F.sum(F.when(F.col("date") < F.lit(rule.start).cast("date"), F.col("n")).otherwise(0)).alias("before_start"),
        F.sum(F.when(F.col("date") > F.lit(rule.end).cast("date"), F.col("n")).otherwise(0)).alias("after_end"),
        F.sum(F.col("n") - 1).alias("repeated_days"),
        F.sum("non_finite").alias("non_finite"),
    )
