"""Ordered operators that never hold one whole key group in one task.

Plain window functions put all rows of a partition key in one task, so a hot key
stalls the job. Here the order is cut into buckets: each bucket is handled on its
own, and only a small table with one row per (key, bucket) is scanned per key.
Inputs are read twice; stage them first when they are costly. Key and bucket columns
must not be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage


def _keyed(df: DataFrame, keys: Sequence[str], bucket: Sequence[Column]) -> tuple[DataFrame, list[str], list[str]]:
    names = [f"__b{i}" for i in range(len(bucket))]
    for name, col in zip(names, bucket):
        df = df.withColumn(name, col)
    keys = list(keys)
    if not keys:
        df = df.withColumn("__all", F.lit(1))
        keys = ["__all"]
    return df, keys, names


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Sequence[Column],
    name: str = "pos",
) -> DataFrame:
    """Add the 0-based position of each row inside its key group.

    ``bucket`` must follow ``order``: all rows of a lower bucket sort first.
    """
    keyed, keys, names = _keyed(df, keys, bucket)
    per_bucket = keyed.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.withColumn(
        "__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))
    ).drop("__n")
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    ranked = keyed.join(offsets, [*keys, *names]).withColumn(
        name, (F.col("__offset") + F.row_number().over(inside) - 1).cast("long")
    )
    return ranked.select(*df.columns, name)


def with_range_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based place of each row in the order of the whole table.

    Rows go to range partitions, as many as the data need, and are numbered inside; the only
    table that one task scans has one row per partition, which also bounds its broadcast.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy("__part").orderBy(*order)
    ranked = ranged.join(F.broadcast(offsets), "__part").withColumn(
        name, (F.col("__offset") + F.row_number().over(inside) - 1).cast("long")
    )
    return ranked.select(*df.columns, name)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Sequence[Column],
    value: str,
    name: str,
) -> DataFrame:
    """Add the value of the preceding row of the key group (null for the first)."""
    keyed, keys, names = _keyed(df, keys, bucket)
    edges = keyed.groupBy(*keys, *names).agg(F.max_by(value, order).alias("__last"))
    carried = edges.withColumn(
        "__carry", F.lag("__last").over(W.partitionBy(*keys).orderBy(*names))
    ).drop("__last")
    inside = W.partitionBy(*keys, *names).orderBy(order)
    joined = keyed.join(carried, [*keys, *names])
    first = F.row_number().over(inside) == 1
    return joined.withColumn(
        name, F.when(first, F.col("__carry")).otherwise(F.lag(value).over(inside))
    ).select(*df.columns, name)


def sorted_runs(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Mapping[str, Column],
) -> DataFrame:
    """Distinct values per key in order, with running weights.

    Returns keys, ``x``, each weight ``w``, ``cum_w`` (this value included), ``total_w``
    of the key and ``next_x``. Equal values are summed before the shuffle, so a value held by a
    third of the rows costs one row per map task. The sort is a range shuffle over
    all tasks; the running totals join per-task offsets.
    """
    keys = list(keys)
    sums = [F.sum(col).alias(name) for name, col in weights.items()]
    runs = (
        df.groupBy(*keys, F.col(value).alias("x"))
        .agg(*sums)
        .repartitionByRange(*keys, "x")
        .withColumn("__part", F.spark_partition_id())
    )
    runs = stage(runs, "runs")
    names = list(weights)
    edges = runs.groupBy(*keys, "__part").agg(
        F.min("x").alias("__first"), *[F.sum(n).alias(f"__sum_{n}") for n in names]
    )
    whole = W.partitionBy(*(keys or [F.lit(1)]))
    by_part = whole.orderBy("__part")
    before = by_part.rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(
        *keys,
        "__part",
        F.lead("__first").over(by_part).alias("__next"),
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in names],
        *[F.sum(f"__sum_{n}").over(whole).alias(f"total_{n}") for n in names],
    )
    inside = W.partitionBy(*keys, "__part").orderBy("x")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = runs.join(edges, [*keys, "__part"])
    return joined.select(
        *keys,
        "x",
        *names,
        *[(F.col(f"__off_{n}") + F.sum(n).over(upto)).alias(f"cum_{n}") for n in names],
        *[f"total_{n}" for n in names],
        F.coalesce(F.lead("x").over(inside), F.col("__next")).alias("next_x"),
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per probability.

    The built-in exact percentile keeps every distinct value of a group in one
    buffer; this reads the order statistics off the distributed sort instead.
    """
    keys = list(keys)
    runs = sorted_runs(df.where(F.col(value).isNotNull()), keys, value, {"n": F.lit(1)})
    picks = []
    for i, p in enumerate(probs.values()):
        rank = F.lit(float(p)) * (F.col("total_n") - 1)
        for side, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            holds = (F.col("cum_n") - F.col("n") <= r) & (r < F.col("cum_n"))
            picks.append(F.max(F.when(holds, F.col("x"))).alias(f"__{side}{i}"))
    picked = runs.groupBy(*keys).agg(F.max("total_n").alias("__total"), *picks)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        rank = F.lit(float(p)) * (F.col("__total") - 1)
        part = rank - F.floor(rank)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * part).alias(name))
    return picked.select(*keys, *out)
