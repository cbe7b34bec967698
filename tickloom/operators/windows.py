"""Strided fixed-length windows, the test index and window checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from ..functions.arrays import finite
from .sequence import with_position, with_previous

RUN_ROWS = 1024


def cut_windows(
    features: DataFrame,
    keys: list[str],
    stride: Column | int,
    proto: Protocol = PROTOCOL,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """All full-length windows that start at positions 0, stride, 2*stride ...

    The ordered rows of a key are cut into runs of ``run_rows`` rows; each run also
    gets the first ``length - 1`` rows of the next one. A run is a bounded group, so a
    hot key spreads over many tasks, and the shuffle grows by (length - 1) / run_rows.
    """
    length = proto.length
    if run_rows < length:
        raise ValueError("run_rows must be at least the window length")
    stride = stride if isinstance(stride, Column) else F.lit(stride)
    placed = with_position(
        features.withColumn("__stride", stride), keys, [F.col("date")], [F.year("date")]
    )
    run = F.floor(F.col("pos") / run_rows).cast("long")
    in_halo = (F.col("pos") % run_rows < length - 1) & (F.col("pos") >= run_rows)
    spread = placed.withColumn(
        "__run", F.explode(F.when(in_halo, F.array(run - 1, run)).otherwise(F.array(run)))
    )
    row = F.struct("pos", "date", *proto.channels)
    runs = spread.groupBy(*keys, "__stride", "__run").agg(
        F.sort_array(F.collect_list(row)).alias("__rows")
    )
    base = F.col("__run") * run_rows
    step = F.col("__stride")
    first = F.ceil(base / step).cast("long") * step
    last_row = F.element_at("__rows", -1)["pos"]
    last = F.least(base + run_rows - 1, last_row - (length - 1))
    starts = F.when(last >= first, F.sequence(first, last, step.cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    cut = runs.withColumn("start_pos", F.explode(starts)).withColumn(
        "__w", F.slice("__rows", (F.col("start_pos") - base + 1).cast("int"), length)
    )
    flat = F.flatten(F.transform("__w", lambda r: F.array(*[r[c] for c in proto.channels])))
    return cut.select(
        *keys,
        "start_pos",
        F.element_at("__w", 1)["date"].alias("window_start_date"),
        F.element_at("__w", -1)["date"].alias("window_end_date"),
        flat.alias("features_flat"),
        F.transform("__w", lambda r: r["date"]).alias("dates"),
    )


def block_stride(name: Column, proto: Protocol = PROTOCOL) -> Column:
    """Stride of the block a row belongs to."""
    stride = F.lit(None).cast("int")
    for rule in proto.blocks:
        stride = F.when(name == rule.name, rule.stride).otherwise(stride)
    return stride


def block_windows(features: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Windows of every training-side block in one job, each with its own stride."""
    rules = [r for r in proto.blocks if r.name != "test_source"]
    stride = block_stride(F.col("feature_block"), proto)
    wanted = features.where(F.col("feature_block").isin([r.name for r in rules]))
    return cut_windows(wanted, ["feature_block", "ticker"], stride, proto).withColumnRenamed(
        "feature_block", "split"
    )


def test_index(features: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Test windows: context may reach back, the target days all lie in the test range.

    The stride counts from the first *valid* start, not from the block start.
    """
    rule = proto.split("test")
    source = features.where((F.col("feature_block") == "test_source") & (F.col("ticker") == proto.target))
    every = cut_windows(source, ["ticker"], 1, proto)
    context = F.slice("dates", 1, proto.context)
    target = F.slice("dates", proto.context + 1, proto.horizon)
    shaped = every.select(
        "ticker", "start_pos", "window_start_date", "window_end_date", "features_flat",
        context.alias("context_dates"), target.alias("target_dates"),
    )
    valid = shaped.where(
        (F.element_at("target_dates", 1) >= F.lit(rule.start).cast("date"))
        & (F.element_at("target_dates", -1) <= F.lit(rule.end).cast("date"))
    )
    ranked = with_position(
        valid, ["ticker"], [F.col("start_pos")], [F.floor(F.col("start_pos") / 4096)], "__valid"
    )
    return ranked.where(F.col("__valid") % proto.test_stride == 0).select(
        F.floor(F.col("__valid") / proto.test_stride).cast("long").alias("test_row"),
        *shaped.columns,
    )


def with_window_index(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Dense 0-based index in (ticker, start) order inside each key."""
    return with_position(
        windows,
        keys,
        [F.col("ticker"), F.col("start_pos")],
        [F.col("ticker"), F.floor(F.col("start_pos") / 4096)],
        "window_idx",
    )


def sessions(windows: DataFrame, keep: list[str], proto: Protocol = PROTOCOL, flat: str = "features_flat") -> DataFrame:
    """One row per (window, t) with the three channels side by side."""
    n = len(proto.channels)
    steps = F.sequence(F.lit(0), F.lit(proto.length - 1))
    per_step = windows.select(*keep, flat, F.explode(steps).alias("t"))
    return per_step.select(
        *keep,
        "t",
        *[F.get(F.col(flat), F.col("t") * n + i).alias(c) for i, c in enumerate(proto.channels)],
    )


def unpivot_channels(df: DataFrame, keep: list[str], proto: Protocol = PROTOCOL) -> DataFrame:
    """Long form (…, channel, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in proto.channels])
    return df.select(*keep, F.explode(cells).alias("__cell")).select(*keep, "__cell.channel", "__cell.value")


def window_long(windows: DataFrame, keep: list[str], proto: Protocol = PROTOCOL, flat: str = "features_flat") -> DataFrame:
    """(…, t, channel, value); a window of the wrong width stops the job."""
    width_error = F.raise_error(F.concat(F.lit("window width "), F.size(flat).cast("string")))
    checked = windows.withColumn(
        flat, F.when(F.size(flat) == proto.width, F.col(flat)).otherwise(width_error)
    )
    return unpivot_channels(sessions(checked, keep, proto, flat), [*keep, "t"], proto)


def unique_daily(
    windows: DataFrame, stride: Column | int, keep: list[str] = ["ticker"], proto: Protocol = PROTOCOL
) -> DataFrame:
    """The distinct daily rows behind overlapping windows, without a shuffle.

    The first window of a ticker owns all its rows, each later one only the last
    ``stride`` rows, which no earlier window holds.
    """
    n = len(proto.channels)
    stride = stride if isinstance(stride, Column) else F.lit(stride)
    own = F.when(F.col("start_pos") == 0, 0).otherwise(F.lit(proto.length) - stride)
    steps = windows.select(
        *keep, "start_pos", "features_flat", F.explode(F.sequence(own, F.lit(proto.length - 1))).alias("t")
    )
    return steps.select(
        *keep,
        (F.col("start_pos") + F.col("t")).alias("daily_pos"),
        *[F.get("features_flat", F.col("t") * n + i).alias(c) for i, c in enumerate(proto.channels)],
    )


def boundary_report(windows: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """First and last day per block against its rule."""
    stats = windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min("window_start_date").alias("min_start"),
        F.max("window_end_date").alias("max_end"),
    )
    lower, upper = F.lit(None).cast("date"), F.lit(None).cast("date")
    for rule in proto.blocks:
        here = F.col("split") == rule.name
        lower = F.when(here, F.lit(rule.start).cast("date")).otherwise(lower)
        upper = F.when(here, F.lit(rule.end).cast("date")).otherwise(upper)
    return stats.withColumn("inside", (F.col("min_start") >= lower) & (F.col("max_end") <= upper))


def target_overlaps(index: DataFrame) -> DataFrame:
    """Distinct target days, and how many sit in more than one window."""
    days = index.select(F.explode("target_dates").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).alias("overlapping_days"),
    )


def target_checks(index: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    rule = proto.split("test")
    return index.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.bool_and(F.size("context_dates") == proto.context).alias("context_complete"),
        F.bool_and(F.size("target_dates") == proto.horizon).alias("target_complete"),
        F.bool_and(F.array_min("target_dates") >= F.lit(rule.start).cast("date")).alias("starts_inside"),
        F.bool_and(F.array_max("target_dates") <= F.lit(rule.end).cast("date")).alias("ends_inside"),
        F.bool_and(F.array_max("context_dates") < F.array_min("target_dates")).alias("context_before_target"),
    )


def expected_counts(features: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """How many windows each block must give, from its row counts alone."""
    rows = features.groupBy("feature_block", "ticker").agg(F.count(F.lit(1)).alias("n"))
    stride = block_stride(F.col("feature_block"), proto)
    n = F.greatest(F.floor((F.col("n") - proto.length) / stride) + 1, F.lit(0))
    return rows.groupBy(F.col("feature_block").alias("split")).agg(F.sum(n).cast("long").alias("expected"))


def stride_check(windows: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Neighbouring starts of a ticker must be one stride apart."""
    gaps = with_previous(
        windows.select("split", "ticker", "start_pos"),
        ["split", "ticker"],
        "start_pos",
        [F.floor(F.col("start_pos") / 4096)],
        "start_pos",
        "prev",
    ).where(F.col("prev").isNotNull())
    off = (F.col("start_pos") - F.col("prev")) != block_stride(F.col("split"), proto)
    return gaps.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(off.cast("int")).alias("wrong_stride")
    )


def hidden_windows(windows: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Full-history windows that end inside the hidden range, relabelled."""
    end = F.lit(proto.split("hidden").end).cast("date")
    return windows.where((F.col("split") == "full_history") & (F.col("window_end_date") <= end)).withColumn(
        "split", F.lit("hidden")
    )


def meta_check(windows: DataFrame, universe: list[str], proto: Protocol = PROTOCOL) -> DataFrame:
    """Violation counts of the window metadata per split."""
    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    start, end = F.col("window_start_date"), F.col("window_end_date")
    return windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_windows"),
        n(F.col("ticker").isNull() | start.isNull() | end.isNull()).alias("null_meta"),
        n(start > end).alias("start_after_end"),
        n(F.size("features_flat") != proto.width).alias("wrong_length"),
        n(F.exists("features_flat", lambda x: ~finite(x))).alias("non_finite"),
        n(~F.col("ticker").isin(universe)).alias("unknown_ticker"),
    )


def universe_check(windows: DataFrame, expected: DataFrame) -> DataFrame:
    """Per split: tickers outside the expected universe and expected ones not seen.

    ``expected`` holds (split, ticker).
    """
    seen = windows.groupBy("split", "ticker").agg(F.lit(1).alias("seen"))
    both = expected.withColumn("wanted", F.lit(1)).join(seen, ["split", "ticker"], "full_outer")
    return both.groupBy("split").agg(
        F.count("wanted").alias("n_expected"),
        F.sum(F.when(F.col("wanted").isNull(), 1).otherwise(0)).alias("n_unknown"),
        F.sum(F.when(F.col("seen").isNull(), 1).otherwise(0)).alias("n_missing"),
    )


def window_profile(windows: DataFrame) -> DataFrame:
    width = F.size("features_flat")
    return windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.countDistinct(width).alias("n_widths"),
        F.min(width).cast("long").alias("min_width"),
        F.max(width).cast("long").alias("max_width"),
    )
