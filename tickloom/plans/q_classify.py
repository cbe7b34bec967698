"""Queries: classifier tests and projections. Iterative fits have no SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import classify, embed, fidelity as fid
from ..operators.sequence import with_range_position
from ..session import stage
from .inputs import POOLS, Inputs, query
from .oracle import r6 as R, sql
from .q_fidelity import rounded

METHODS = [m for m, _, _ in POOLS]


@query("c2st")
def c2st(i: Inputs) -> DataFrame:
    return rounded(i.c2st, ["method", "n"], ["roc_auc", "accuracy"])


@query("c2st_folds")
def c2st_folds(i: Inputs) -> DataFrame:
    """Fold-wise scores, and a 25 % holdout: the first of four folds."""
    folds = i.c2st_scores
    quarter = i.pairs(4).withColumn("fold", F.when(F.col("fold") == 0, 0).otherwise(1))
    held = classify.out_of_fold_scores(quarter, "method", METHODS, folds=1)
    report = classify.holdout_report(held, "method").withColumnsRenamed(
        {"roc_auc": "holdout_auc", "accuracy": "holdout_accuracy", "n": "n_holdout"}
    )
    names = ["auc_mean", "auc_std", "accuracy_mean", "accuracy_std", "holdout_auc", "holdout_accuracy", "precision", "recall"]
    return rounded(classify.fold_metrics(folds, "method").join(report, "method"), ["method", "n_holdout"], names)


@query("c2st_grid")
def c2st_grid(i: Inputs) -> DataFrame:
    """One pool per seed against donor_train, donor_validation and both, balanced."""
    pools = reduce(DataFrame.unionByName, [i.pool("bootstrap_jitter", s) for s in i.proto.seeds])
    pools = stage(pools, "seed_pools").withColumnRenamed("synthetic_id", "row_id")
    train = i.donors.select(F.col("donor_idx").alias("row_id"), "features_flat")
    valid = i.real_rows.select(F.col("window_id").alias("row_id"), "features_flat")
    both = train.unionByName(valid.withColumn("row_id", F.col("row_id") + i.n_donors))
    parts, groups = [], []
    for name, real in (("donor_train", train), ("donor_validation", valid), ("both", both)):
        for seed in i.proto.seeds:
            group = f"{name}:{seed}"
            groups.append(group)
            a = real.select(F.lit(group).alias("comparison"), F.lit(0).alias("label"), "row_id", "features_flat")
            b = pools.where(F.col("seed") == seed).select(F.lit(group).alias("comparison"), F.lit(1).alias("label"), "row_id", "features_flat")
            pair = stage(a.unionByName(b), "pair")
            parts.append(fid.balanced_sample(pair, "label", "row_id", seed))
    rows = reduce(DataFrame.unionByName, parts)
    folded = stage(classify.with_folds(rows, "comparison"), "folded")
    scores = classify.out_of_fold_scores(folded, "comparison", groups)
    split = F.split("comparison", ":")
    table = classify.fold_metrics(scores, "comparison").select(split[0].alias("reference"), split[1].cast("int").alias("seed"), "*")
    return rounded(table, ["reference", "seed"], ["auc_mean", "auc_std", "accuracy_mean", "accuracy_std"])


@query("discriminative_score")
def discriminative_score(i: Inputs) -> DataFrame:
    return rounded(classify.discriminative_score(i.pairs(10), "method", METHODS), ["method", "n"], ["accuracy", "score"])


@query("pca_embedding")
def pca_embedding(i: Inputs) -> DataFrame:
    return rounded(classify.pca_embedding(i.evaluation, ["method", "window_id"]), ["method", "window_id"], ["pc1", "pc2"])


@query("neighbour_embedding")
def neighbour_embedding(i: Inputs) -> DataFrame:
    """All evaluation windows in one picture that keeps neighbours together; it begins at the components."""
    named = stage(with_range_position(i.evaluation, ["method", "window_id"], "i"), "embed-rows")
    edges = embed.neighbour_graph(named, "i", "features_flat")
    start = classify.pca_embedding(named, ["i"]).withColumnsRenamed({"pc1": "x", "pc2": "y"})
    found = embed.embed(edges, start, named.count(), i.proto.seeds[0])
    return rounded(found.join(named.select("i", "method", "window_id"), "i"), ["method", "window_id"], ["x", "y"])


# Roots of the characteristic cubic of three correlations, largest first, and for each root the cross
# product of two rows of (R - root) that is longest, which is its eigenvector.
SHARE_SQL = f"""
, r AS (SELECT corr(c0, c1) AS a, corr(c0, c2) AS b, corr(c1, c2) AS c FROM nsteps WHERE split = 'donor_train')
, p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS s FROM r)
, l AS (SELECT a, b, c, k, 1 + 2 * s * cos((acos(least(1, greatest(-1, a * b * c / (s * s * s)))) - 2 * pi() * (CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END)) / 3) AS root
  FROM p, (SELECT unnest([1, 2, 3]) AS k))
, o AS (SELECT *, row_number() OVER (ORDER BY root DESC) AS j FROM l)
, x AS (SELECT j, root, unnest([
    [a * c - b * (1 - root), b * a - c * (1 - root), (1 - root) * (1 - root) - a * a],
    [a * (1 - root) - b * c, b * b - (1 - root) * (1 - root), (1 - root) * c - a * b],
    [(1 - root) * (1 - root) - c * c, c * b - a * (1 - root), a * c - (1 - root) * b]]) AS v FROM o)
, e AS (SELECT j, root, arg_max(v, list_sum(list_transform(v, lambda q: q * q))) AS v FROM x GROUP BY j, root)
, u AS (SELECT j, root, list_transform(v, lambda q: q / sqrt(list_sum(list_transform(v, lambda w: w * w)))) AS v FROM e)
, g AS (SELECT j, root, list_transform(v, lambda q: q * sign(list_aggregate(v, 'max') + list_aggregate(v, 'min'))) AS v FROM u)
SELECT 'pc' || j AS component, ['log_return', 'log_high_low_range', 'log1p_volume'][i] AS channel,
  {R('v[i]', 'loading')}, {R('v[i] * v[i]', 'share')}, {R('root / 3', 'explained_ratio')} FROM g, (SELECT unnest([1, 2, 3]) AS i)"""


@query("pca_channel_share", sql("nsteps", SHARE_SQL))
def pca_channel_share(i: Inputs) -> DataFrame:
    return rounded(classify.channel_shares(i.real("donor_train")), ["component", "channel"], ["loading", "share", "explained_ratio"])
