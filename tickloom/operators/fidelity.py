"""How close synthetic windows are to held-out real ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import PROTOCOL, Protocol
from ..functions import hashrand
from ..functions.arrays import channel, std_pop
from ..session import broadcast_if_small
from .draw import first_rows
from .neighbours import nearest
from .sequence import quantiles, sorted_runs, with_position
from .pairs import mmd_rbf, pairwise_distances  # noqa: F401
from .windows import sessions, unpivot_channels

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
MAX_LAG = 20
#: Rows of a bucket of a hash order, in the mean.
BUCKET_ROWS = 100_000


# --- samples ---------------------------------------------------------------


def seeded_order(df: DataFrame, keys: list[str], row_id: str, seed: int, name: str) -> DataFrame:
    """0-based place of each row in a seeded shuffle of its key group.

    The hash order is cut into as many buckets as the rows fill.
    """
    buckets = min(hashrand.MOST_BUCKETS, max(1, df.count() // BUCKET_ROWS))
    keyed = df.withColumn("__key", hashrand.order_key(F.col(row_id), seed))
    placed = with_position(
        keyed, keys, [F.col("__key"), F.col(row_id)], [hashrand.order_bucket(F.col("__key"), buckets)], name
    )
    return placed.drop("__key")


def common_subset(ids: DataFrame, row_id: str, k: Column | int, seed: int) -> DataFrame:
    """``k`` ids without replacement, one draw for every method; an error if there are fewer."""
    k = k if isinstance(k, Column) else F.lit(k)
    size = ids.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    told = F.concat_ws(" ", F.lit("the subset needs"), F.col("__k").cast("string"), F.lit("of"), F.col("__size").cast("string"), F.lit("ids"))
    sized = ids.select(row_id).withColumns({"__k": k, "__size": size})
    enough = F.when(F.col("__k") > F.col("__size"), F.raise_error(told).cast("long")).otherwise(F.col("__k").cast("long"))
    return first_rows(sized, [], row_id, seed, F.array(enough)).select(row_id)


def apply_subset(pools: DataFrame, subset: DataFrame, row_id: str) -> DataFrame:
    return pools.join(broadcast_if_small(subset), row_id, "left_semi").select(*pools.columns)


def pick(df: DataFrame, keys: list[str], row_id: str, seed: int, n: Column, limit: int | None = None) -> DataFrame:
    """The first ``n`` rows of each key in seeded order, ``limit`` at most."""
    if limit is not None:
        n = F.least(n, F.lit(limit))
    sized = df.withColumn("__wanted", F.array(n.cast("long")))
    return first_rows(sized, keys, row_id, seed, F.col("__wanted")).select(*df.columns)


def balanced_sample(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """The same number of rows of each label, picked by seeded shuffle."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n").alias("n")).select("n").scalar()
    return pick(df, [label], row_id, seed, smallest)


# --- moments and distributions ---------------------------------------------


def marginal_stats(steps: DataFrame, keys: list[str], bias: bool, proto: Protocol = PROTOCOL) -> DataFrame:
    """Moments and exact percentiles per channel; skew and kurtosis with or without bias."""
    long = unpivot_channels(steps, keys, proto)
    by = [*keys, "channel"]
    x, n = F.col("value"), F.col("n")
    stats = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.skewness(x).alias("g1"),
        F.kurtosis(x).alias("g2"),
    )
    if bias:
        skew, kurt = F.col("g1"), F.col("g2")
    else:
        skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1.0)) / (n - 2.0))
        kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.col("g2") + 6.0))
    stats = stats.select(*by, "n", "mean", "std", "min", "max", skew.alias("skewness"), kurt.alias("excess_kurtosis"))
    return stats.join(quantiles(long, by, "value", PERCENTILES), by)


def wasserstein(values: DataFrame, methods: list[str]) -> DataFrame:
    """Exact empirical 1-Wasserstein distance of each method to "real", per channel.

    ``values`` holds (method, channel, value). The distance is the area between two
    distribution functions. One distributed sort per channel carries the running count
    of every method, so the real values are neither repeated nor sorted again.
    """
    counts = {name: (F.col("method") == name).cast("long") for name in ["real", *methods]}
    runs = sorted_runs(values, ["channel"], "value", counts)
    step = F.coalesce(F.col("next_x") - F.col("x"), F.lit(0.0))
    share = lambda name: F.col(f"cum_{name}") / F.col(f"total_{name}")
    areas = runs.groupBy("channel").agg(
        *[F.sum(F.abs(share(m) - share("real")) * step).alias(m) for m in methods]
    )
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("wasserstein_1")) for m in methods])
    return areas.select("channel", F.explode(cells).alias("__c")).select("__c.method", "channel", "__c.wasserstein_1")


def histogram(long: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Density per key over bins shared by all keys of a channel; the last bin is closed.

    A channel with one value only gets a range of half a unit to each side of it.
    """
    edges = long.groupBy("channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    edges = edges.select("channel", (F.col("lo") - flat).alias("lo"), (F.col("hi") + flat).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    # One row per protocol channel, so the broadcast never grows with the data.
    placed = long.join(F.broadcast(edges), "channel").withColumn("width", width).withColumn(
        "bin", F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("long")
    )
    by = [*keys, "channel"]
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    sizes = placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.any_value("lo").alias("lo"), F.any_value("width").alias("width")
    )
    grid = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("total") * F.col("width"))).alias("density"),
    )


# --- time structure --------------------------------------------------------


def _lag_sums(x: np.ndarray, lags: list[int]) -> np.ndarray:
    """(lags, 6) of series x (windows, steps): count, sum and squares of the biased autocorrelations
    of windows that vary, count and sum of the Pearson correlations of x[:-k] with x[k:] where
    neither side is flat, and the lag."""
    d = x - x.mean(axis=1, keepdims=True)
    v = np.einsum("nt,nt->n", d, d)
    moves = v > 0
    out = np.zeros((len(lags), 6))
    for row, k in zip(out, lags):
        a, b = d[:, : x.shape[1] - k], d[:, k:]
        acf = np.einsum("nt,nt->n", a[moves], b[moves]) / v[moves]
        row[:3] = acf.size, acf.sum(), (acf * acf).sum()
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        va, vb = (np.einsum("nt,nt->n", y, y) / a.shape[1] for y in (a, b))
        both = (np.sqrt(va) > 1e-8) & (np.sqrt(vb) > 1e-8)
        corr = np.einsum("nt,nt->n", a[both], b[both]) / a.shape[1] / np.sqrt(va[both] * vb[both])
        row[3:] = corr.size, corr.sum(), k
    return out


def lag_table(windows: DataFrame, keys: list[str], series: dict[str, Column], lags: list[int]) -> DataFrame:
    """(keys, channel, lag, acf, acf_std, valid_windows, pearson, pearson_windows) in one pass.

    ``acf`` is the mean biased autocorrelation of windows with variance, ``pearson`` the mean
    correlation of x[:-k] with x[k:] of windows where neither side is flat. A task takes the windows
    of a batch as matrices, and returns one row per key, series and lag.
    """
    own = windows.select(F.struct(*keys).alias("k"), *[c.alias(f"x{j}") for j, c in enumerate(series.values())])
    key_type = own.schema["k"].dataType
    names = list(series)

    def sums(batches):
        total: dict = {}
        values: dict = {}
        for batch in batches:
            code = batch.column(0).to_pylist()
            groups: dict = {}
            for row, k in enumerate(code):
                groups.setdefault(tuple(k.values()), []).append(row)
            xs = [np.asarray(c.flatten(), dtype=float).reshape(batch.num_rows, -1) for c in batch.columns[1:]]
            for k, rows in groups.items():
                values[k] = code[rows[0]]
                part = np.stack([_lag_sums(x[rows], lags) for x in xs])
                part[:, :, 5] = 0
                total[k] = total[k] + part if k in total else part
        rows = [(values[k], j, i, *t[j, i, :5]) for k, t in total.items() for j in range(len(names)) for i in range(len(lags))]
        if rows:
            columns = list(zip(*rows))
            types = [to_arrow_type(key_type), pa.int32(), pa.int32(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["k", "j", "i", "n", "s", "ss", "pn", "ps"])

    parts = own.mapInArrow(sums, f"k {key_type.simpleString()}, j int, i int, n double, s double, ss double, pn double, ps double")
    added = parts.groupBy("k", "j", "i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "pn", "ps")])
    mean_ = F.try_divide("s", "n")
    return added.select(
        "k.*",
        F.get(F.array(*map(F.lit, names)), F.col("j")).alias("channel"),
        F.get(F.array(*map(F.lit, lags)), F.col("i")).alias("lag"),
        mean_.alias("acf"),
        F.sqrt(F.greatest(F.try_divide("ss", "n") - mean_ * mean_, F.lit(0.0))).alias("acf_std"),
        F.col("n").cast("long").alias("valid_windows"),
        F.try_divide("ps", "pn").alias("pearson"),
        F.col("pn").cast("long").alias("pearson_windows"),
    )


def return_series() -> dict[str, Column]:
    """The returns of a window and their absolute values."""
    returns = channel(F.col("features_flat"), 0)
    return {"log_return": returns, "abs_return": F.transform(returns, lambda x: F.abs(x))}


def acf_table(windows: DataFrame, absolute: bool) -> DataFrame:
    """Autocorrelation of each method against the real one, lags 1..20, with their MAE.

    ``windows`` holds (method, features_flat) with the real windows as method "real".
    """
    return acf_curves(lag_table(windows, ["method"], return_series(), list(range(1, MAX_LAG + 1))), absolute)


def acf_curves(lags: DataFrame, absolute: bool) -> DataFrame:
    """``acf_table`` from a table of lags of ``return_series``, such as a stage of it."""
    curves = lags.where((F.col("channel") == ("abs_return" if absolute else "log_return")) & (F.col("lag") <= MAX_LAG))
    real = curves.where(F.col("method") == "real").select(
        "lag", F.col("acf").alias("real_acf"), F.col("valid_windows").alias("real_valid_windows")
    )
    other = curves.where(F.col("method") != "real").select(
        "method", "lag", F.col("acf").alias("synthetic_acf"), F.col("valid_windows").alias("synthetic_valid_windows")
    )
    both = other.join(real, "lag").withColumn("difference", F.col("synthetic_acf") - F.col("real_acf"))
    both = both.withColumn("absolute_difference", F.abs("difference"))
    # At most MAX_LAG rows per method are left here.
    return both.withColumn("acf_mae", F.avg("absolute_difference").over(W.partitionBy("method")))


def acf_gaps(table: DataFrame) -> DataFrame:
    """Mean and largest gap per method, and the lag of the largest."""
    gap = F.col("absolute_difference")
    return table.groupBy("method").agg(
        F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.max_by("lag", gap).alias("lag_of_max")
    )


# --- channel dependence ----------------------------------------------------


def channel_corr(steps: DataFrame, keys: list[str], proto: Protocol = PROTOCOL) -> DataFrame:
    """3x3 Pearson matrix over pooled sessions in long form."""
    a, b, c = proto.channels
    r = steps.groupBy(*keys).agg(F.corr(a, b).alias("ab"), F.corr(a, c).alias("ac"), F.corr(b, c).alias("bc"))
    pair = {(a, b): "ab", (a, c): "ac", (b, c): "bc"}
    cells = [
        F.struct(
            F.lit(x).alias("row_channel"),
            F.lit(y).alias("column_channel"),
            (F.lit(1.0) if x == y else F.col(pair.get((x, y)) or pair[(y, x)])).alias("correlation"),
        )
        for x in proto.channels
        for y in proto.channels
    ]
    return r.select(*keys, F.explode(F.array(*cells)).alias("__c")).select(*keys, "__c.*")


def corr_errors(matrices: DataFrame) -> DataFrame:
    """Mean and largest off-diagonal gap to the method "real"."""
    on = ["row_channel", "column_channel"]
    off = matrices.where(F.col("row_channel") != F.col("column_channel"))
    real = off.where(F.col("method") == "real").select(*on, F.col("correlation").alias("real"))
    gap = F.abs(F.col("correlation") - F.col("real"))
    return off.where(F.col("method") != "real").join(real, on).groupBy("method").agg(
        F.avg(gap).alias("mean_abs_off_diagonal"), F.max(gap).alias("max_abs_off_diagonal")
    )


# --- distances -------------------------------------------------------------


def nearest_train(queries: DataFrame, train: DataFrame) -> DataFrame:
    """Distance of each (method, window_id) to its nearest donor."""
    # Window ids repeat over the methods; one dense id per query.
    tagged = with_position(
        queries.select("method", "window_id", F.col("features_flat").alias("vec")),
        [],
        [F.col("method"), F.col("window_id")],
        [F.col("method"), F.floor(F.col("window_id") / 65536)],
        "qid",
    )
    found = nearest(tagged, train.select("donor_idx", F.col("features_flat").alias("vec")), [], "qid", "donor_idx")
    return tagged.drop("vec").join(found, "qid").select("method", "window_id", "donor_idx", "distance")


def distance_summary(distances: DataFrame, keys: list[str], value: str = "distance") -> DataFrame:
    stats = distances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    probs = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95}
    return stats.join(quantiles(distances, keys, value, probs), keys)


def memorization(distances: DataFrame, near: float = 1e-6) -> DataFrame:
    """Exact and near-exact copies of donors per method."""
    return distances.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("distance") == 0.0).cast("int")).alias("exact_copies"),
        F.sum((F.col("distance") <= near).cast("int")).alias("near_copies"),
    )


def repeated_windows(pools: DataFrame, keys: list[str], flat: str = "features_flat") -> DataFrame:
    """``(keys, copies)`` of every window value that occurs more than once.

    A 64-bit hash goes through the first shuffle instead of the arrays; only windows
    whose hash repeats are compared in full.
    """
    hashed = pools.withColumn("__h", F.xxhash64(flat))
    often = hashed.groupBy(*keys, "__h").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).drop("__n")
    return (
        hashed.join(often, [*keys, "__h"], "left_semi")
        .groupBy(*keys, flat)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select(*keys, "copies")
    )


def diversity(pools: DataFrame, keys: list[str], proto: Protocol = PROTOCOL, flat_tol: float = 1e-8) -> DataFrame:
    """Unique windows, surplus copies, channel variances and collapsed windows."""
    stds = pools.select(*keys, *[std_pop(channel(F.col("features_flat"), k)).alias(f"s{k}") for k in range(3)])
    low = [F.col(f"s{k}") <= flat_tol for k in range(3)]
    collapsed = stds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        *[F.sum(low[k].cast("int")).alias(f"collapsed_{c}") for k, c in enumerate(proto.channels)],
        F.sum((low[0] | low[1] | low[2]).cast("int")).alias("collapsed_any"),
    )
    surplus = repeated_windows(pools, keys).groupBy(*keys).agg(F.sum(F.col("copies") - 1).alias("duplicates"))
    variances = sessions(pools, keys, proto).groupBy(*keys).agg(
        *[F.var_pop(c).alias(f"variance_{c}") for c in proto.channels]
    )
    return (
        collapsed.join(surplus, keys, "left")
        .fillna(0, ["duplicates"])
        .withColumn("n_unique", F.col("n_windows") - F.col("duplicates"))
        .join(variances, keys)
    )


def bounded_sample(df: DataFrame, keys: list[str], row_id: str, seed: int, limit: int) -> DataFrame:
    """At most ``limit`` rows per key."""
    return pick(df, keys, row_id, seed, F.lit(limit), limit)


# --- scores of a classifier ------------------------------------------------


def score_runs(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct scores in order with running counts of both labels."""
    return sorted_runs(
        scores, keys, "score", {"n0": (F.col("label") == 0).cast("long"), "n1": (F.col("label") == 1).cast("long")}
    )


def roc_auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-aware area under the ROC curve and accuracy at one half."""
    wins = F.col("n1") * (F.col("cum_n0") - F.col("n0") + F.col("n0") / 2.0)
    auc = score_runs(scores, keys).groupBy(*keys).agg(
        (F.sum(wins) / (F.sum("n0") * F.sum("n1"))).alias("roc_auc")
    )
    hit = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    return auc.join(scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")), keys)


def roc_curve(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One point per distinct threshold: rates of scores at or above it."""
    above = lambda c: (F.col(f"total_{c}") - F.col(f"cum_{c}") + F.col(c)) / F.col(f"total_{c}")
    return score_runs(scores, keys).select(
        *keys, F.col("x").alias("threshold"), above("n0").alias("fpr"), above("n1").alias("tpr")
    )


def confusion(scores: DataFrame, keys: list[str]) -> DataFrame:
    """2x2 counts per key; cells that never occur are kept as zero."""
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    predicted = (F.col("score") >= 0.5).cast("int")
    counted = scores.groupBy(*keys).agg(
        *[
            F.sum(((F.col("label") == a) & (predicted == b)).cast("long")).alias(f"c{a}{b}")
            for a, b in cells
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(a).alias("label"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n")) for a, b in cells]
    )
    return counted.select(*keys, F.explode(rows).alias("__c")).select(*keys, "__c.*")


def verdict(auc: Column) -> Column:
    """How far the classifier is from guessing."""
    gap = F.abs(auc - 0.5)
    return (
        F.when(gap < 0.05, "excellent").when(gap < 0.10, "good").when(gap < 0.20, "moderate").otherwise("distinguishable")
    )
