"""Synthetic windows by resampling donor windows, with hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..config import PROTOCOL, Protocol
from ..functions import hashrand
from ..functions.arrays import absolute, channel, mean, std_pop, total
from ..session import broadcast_if_small, stage
from .neighbours import nearest
from .scaling import ZERO_STD
from .sequence import quantiles, with_position
from .windows import sessions

DRAWS_PER_TASK = 8192
SUMMARY = ("ret_std", "ret_abs_mean", "ret_sum", "range_mean", "volume_mean", "volume_std")


def donor_rows(windows: DataFrame) -> DataFrame:
    """Donors with a dense 0-based index, in (ticker, start) order."""
    return with_position(
        windows,
        [],
        [F.col("ticker"), F.col("start_pos")],
        [F.col("ticker"), F.floor(F.col("start_pos") / 4096)],
        "donor_idx",
    )


def draw_indices(spark: SparkSession, lo: int, hi: int, size: Column, seed: int) -> DataFrame:
    """``(synthetic_id, donor_idx)`` for ids in [lo, hi): uniform draws with replacement."""
    tasks = max(spark.sparkContext.defaultParallelism, (hi - lo) // DRAWS_PER_TASK)
    ids = spark.range(lo, hi, 1, tasks).withColumnRenamed("id", "synthetic_id")
    index = F.floor(hashrand.uniform(F.col("synthetic_id"), seed, "index") * size).cast("long")
    return ids.withColumn("donor_idx", index)


def bootstrap(donors: DataFrame, draws: DataFrame) -> DataFrame:
    """Attach the donor window of each draw. Draw indices are uniform, so the join is even."""
    return draws.join(broadcast_if_small(donors.select("donor_idx", "features_flat")), "donor_idx")


def jitter(df: DataFrame, seed: int, sigma: float, proto: Protocol = PROTOCOL) -> DataFrame:
    """Add independent N(0, sigma) noise to each value."""
    noise = hashrand.normals(F.col("synthetic_id"), seed, proto.width)
    return df.withColumn("features_flat", F.zip_with("features_flat", noise, lambda x, z: x + F.lit(sigma) * z))


def correlation_row(windows: DataFrame, proto: Protocol = PROTOCOL) -> Column:
    """Cholesky factor of the channel correlation as a scalar struct.

    Pivots are floored at 1e-6 so a near-singular matrix still gives a factor.
    """
    a, b, c = proto.channels
    steps = sessions(windows, [], proto)
    r = steps.agg(F.corr(a, b).alias("ab"), F.corr(a, c).alias("ac"), F.corr(b, c).alias("bc"))
    l22 = F.sqrt(F.greatest(1.0 - F.col("ab") * F.col("ab"), F.lit(1e-6)))
    with_l22 = r.withColumn("l22", l22).withColumn("l32", (F.col("bc") - F.col("ab") * F.col("ac")) / F.col("l22"))
    l33 = F.sqrt(F.greatest(1.0 - F.col("ac") * F.col("ac") - F.col("l32") * F.col("l32"), F.lit(1e-6)))
    return with_l22.select(
        F.struct(F.col("ab").alias("l21"), "l22", F.col("ac").alias("l31"), "l32", l33.alias("l33"))
    ).scalar()


def _ar1_step(rho: float):
    """Fold step that appends rho * last + sqrt(1 - rho^2) * shock."""
    fresh = (1.0 - rho * rho) ** 0.5

    def step(acc: Column, shock: Column) -> Column:
        after = F.zip_with(F.element_at(acc, -1), shock, lambda n, e: F.lit(rho) * n + F.lit(fresh) * e)
        return F.array_append(acc, after)

    return step


def temporal_noise(
    df: DataFrame, seed: int, chol: Column, rhos: tuple[float, ...], proto: Protocol = PROTOCOL
) -> DataFrame:
    """Add one unit-scale noise array per AR(1) coefficient: ``noise_0``, ``noise_1`` ...

    Shocks are correlated over the channels by ``chol`` and follow
    n_t = rho n_{t-1} + sqrt(1 - rho^2) e_t in time; ``rho=0`` is white in time.
    All of them share one set of normals.
    """
    drawn = df.withColumn("__chol", chol).withColumn(
        "__z", hashrand.normals(F.col("synthetic_id"), seed, proto.width)
    )
    z, c = F.col("__z"), F.col("__chol")

    def shock(t: Column) -> Column:
        z0, z1, z2 = (F.get(z, t * 3 + i) for i in range(3))
        return F.array(z0, c["l21"] * z0 + c["l22"] * z1, c["l31"] * z0 + c["l32"] * z1 + c["l33"] * z2)

    drawn = drawn.withColumn("__e", F.transform(F.sequence(F.lit(0), F.lit(proto.length - 1)), shock))
    for k, rho in enumerate(rhos):
        noise = F.col("__e")
        if rho > 0.0:
            noise = F.aggregate(F.slice("__e", 2, proto.length - 1), F.slice("__e", 1, 1), _ar1_step(rho))
        drawn = drawn.withColumn(f"noise_{k}", F.flatten(noise))
    return drawn.drop("__chol", "__z", "__e")


def temporal_jitter(
    df: DataFrame, seed: int, sigma: float, rho: float, chol: Column, proto: Protocol = PROTOCOL
) -> DataFrame:
    """Add channel-correlated noise of scale ``sigma`` with time correlation ``rho``."""
    noisy = temporal_noise(df, seed, chol, (rho,), proto)
    added = F.zip_with("features_flat", "noise_0", lambda x, n: x + F.lit(sigma) * n)
    return noisy.withColumn("features_flat", added).drop("noise_0")


def window_summary(df: DataFrame, keep: list[str]) -> DataFrame:
    """Six raw summary numbers of each window."""
    flat = F.col("features_flat")
    parts = df.select(*keep, channel(flat, 0).alias("r"), channel(flat, 1).alias("h"), channel(flat, 2).alias("v"))
    r, h, v = F.col("r"), F.col("h"), F.col("v")
    cols = (std_pop(r), mean(absolute(r)), total(r), mean(h), mean(v), std_pop(v))
    return parts.select(*keep, *[c.alias(n) for n, c in zip(SUMMARY, cols)])


def standardized_summary(summary: DataFrame, keep: list[str]) -> DataFrame:
    """Summary numbers as z-scores (population std) over all rows."""
    stats = summary.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in SUMMARY],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in SUMMARY],
        ).alias("s")
    ).select("s").scalar()
    out = []
    for c in SUMMARY:
        sd = stats[f"s_{c}"]
        out.append(((F.col(c) - stats[f"m_{c}"]) / F.when(sd < ZERO_STD, 1.0).otherwise(sd)).alias(c))
    return summary.select(*keep, *out)


# Score, weight of its level, and the quantiles that cut it.
REGIME_CUTS = (("vol", 6, ("third", "two_thirds")), ("trend", 2, ("third", "two_thirds")), ("volume", 1, ("half",)))


def regime_labels(summary: DataFrame) -> DataFrame:
    """Add ``regime`` 0..17 from volatility thirds, trend thirds and volume halves.

    The cuts of all three scores come from one distributed sort.
    """
    scores = {
        "vol": 0.5 * F.col("ret_std") + 0.5 * F.col("range_mean"),
        "trend": F.col("ret_sum"),
        "volume": F.col("volume_mean"),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("score"), c.alias("x")) for n, c in scores.items()])
    long = summary.select(F.explode(cells).alias("c")).select("c.score", "c.x")
    cuts = quantiles(long, ["score"], "x", {"third": 1 / 3, "two_thirds": 2 / 3, "half": 0.5})
    names = [(score, q) for score, _, qs in REGIME_CUTS for q in qs]
    row = cuts.agg(
        F.struct(*[F.max(F.when(F.col("score") == s, F.col(q))).alias(f"{s}_{q}") for s, q in names]).alias("cuts")
    ).select("cuts").scalar()
    placed = summary.withColumn("__cuts", row)
    regime = F.lit(0)
    for score, weight, qs in REGIME_CUTS:
        level = sum(((scores[score] >= F.col("__cuts")[f"{score}_{q}"]).cast("int") for q in qs), F.lit(0))
        regime = regime + F.lit(weight) * level
    return placed.withColumn("regime", regime).drop("__cuts")


def regime_members(labels: DataFrame) -> DataFrame:
    """Dense index of each donor inside its regime; a hot regime is bucketed by donor."""
    return with_position(
        labels, ["regime"], [F.col("donor_idx")], [F.floor(F.col("donor_idx") / 65536)], "member_idx"
    )


def regime_shares(labels: DataFrame) -> DataFrame:
    """At most 18 rows: cumulative share [lo, hi) of each regime, and its size."""
    sizes = labels.groupBy("regime").agg(F.count(F.lit(1)).alias("n_members"))
    upto = W.partitionBy(F.lit(1)).orderBy("regime").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(F.lit(1))
    cum = F.sum("n_members").over(upto)
    all_rows = F.sum("n_members").over(whole)
    return sizes.select(
        "regime", "n_members", ((cum - F.col("n_members")) / all_rows).alias("lo"), (cum / all_rows).alias("hi")
    )


def draw_regime_members(draws: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """Regime by frequency, then a member of it uniformly.

    The shares are at most 18 rows, held as one scalar array, so no range join is needed.
    """
    shares = regime_shares(labels).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "regime", "n_members"))).alias("s")
    ).select("s").scalar()
    u = hashrand.uniform(F.col("synthetic_id"), seed, "regime")
    drawn = draws.withColumn("__u", u).withColumn("__shares", shares)
    hit = F.element_at(F.filter("__shares", lambda s: s["lo"] <= F.col("__u")), -1)
    drawn = drawn.withColumn("__hit", hit)
    member = F.floor(hashrand.uniform(F.col("synthetic_id"), seed, "member") * F.col("__hit.n_members"))
    picked = drawn.select("synthetic_id", F.col("__hit.regime").alias("regime"), member.cast("long").alias("member_idx"))
    members = regime_members(labels).select("regime", "member_idx", "donor_idx")
    return picked.join(members, ["regime", "member_idx"])


def beta_8_2(row_id: Column, seed: int) -> Column:
    """Beta(8, 2) as the 8th smallest of 9 uniforms."""
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(8)), lambda k: hashrand.uniform(row_id, seed, F.concat(F.lit("beta"), k.cast("string")))
    )
    return F.element_at(F.array_sort(draws), 8)


def regime_neighbours(labelled: DataFrame, k: int = 12) -> DataFrame:
    """Up to ``k`` nearest members of the same regime, self left out.

    ``labelled`` holds (donor_idx, regime, six standardized summary numbers). A donor
    alone in its regime is its own neighbour.
    """
    points = labelled.select("regime", "donor_idx", F.array(*SUMMARY).alias("vec"))
    near = nearest(
        points, points.withColumnRenamed("donor_idx", "mate_idx"), ["regime"], "donor_idx", "mate_idx", k, skip_same_id=True
    )
    near = stage(near, "neighbours")  # read several times below and by every mixture
    alone = labelled.select("regime", "donor_idx").join(near, ["regime", "donor_idx"], "left_anti").select(
        "regime", "donor_idx", F.col("donor_idx").alias("mate_idx"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")
    )
    return near.unionByName(alone)


def mixup(base: DataFrame, neighbours: DataFrame, donors: DataFrame, seed: int) -> DataFrame:
    """Convex mix of each drawn donor with one of its neighbours.

    ``base`` holds (synthetic_id, donor_idx). The weight is Beta(8, 2), mirrored with
    probability one half.
    """
    sizes = neighbours.groupBy("donor_idx").agg(F.count(F.lit(1)).alias("n_near"))
    row_id = F.col("synthetic_id")
    rank = F.floor(hashrand.uniform(row_id, seed, "mate") * F.col("n_near")).cast("int") + 1
    mates = base.join(sizes, "donor_idx").withColumn("rank", rank).join(
        neighbours.select("donor_idx", "rank", "mate_idx"), ["donor_idx", "rank"]
    )
    beta = beta_8_2(row_id, seed)
    weight = F.when(hashrand.uniform(row_id, seed, "mirror") < 0.5, beta).otherwise(1.0 - beta)
    windows = donors.select("donor_idx", "features_flat")
    mate_windows = donors.select(F.col("donor_idx").alias("mate_idx"), F.col("features_flat").alias("__mate"))
    both = (
        mates.withColumn("weight", weight)
        .join(broadcast_if_small(windows), "donor_idx")
        .join(broadcast_if_small(mate_windows), "mate_idx")
    )
    mixed = F.zip_with("features_flat", "__mate", lambda a, b: F.col("weight") * a + (1.0 - F.col("weight")) * b)
    return both.select("synthetic_id", "donor_idx", "mate_idx", "weight", mixed.alias("features_flat"))


def repro_report(first: DataFrame, again: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between two builds of one seed, and from another seed."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("features_flat").alias(name))

    joined = side(first, "a").join(side(again, "b"), keys, "full_outer").join(side(other, "c"), keys, "full_outer")
    differs = lambda x, y: F.sum((~F.col(x).eqNullSafe(F.col(y))).cast("int"))
    return joined.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_windows"),
        differs("a", "b").alias("differ_same_seed"),
        differs("a", "c").alias("differ_other_seed"),
    )


def canonical_frame(
    pool: DataFrame, source_model: str | Column, seed: int | Column, proto: Protocol = PROTOCOL, columns: list[str] | None = None
) -> DataFrame:
    """The eight contract columns."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return pool.select(
        "synthetic_id",
        as_col(source_model).alias("source_model"),
        as_col(seed).cast("int").alias("training_seed"),
        F.lit(proto.space).alias("space"),
        F.lit(proto.length).alias("window_length"),
        F.lit(len(proto.channels)).alias("n_channels"),
        F.array(*[F.lit(c) for c in proto.channels]).alias("channel_order"),
        "features_flat",
        *(columns or []),
    )
