"""Classifier two-sample tests and projections with distributed fits."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from . import fidelity
from .fidelity import seeded_order
from .logit import Fits
from .windows import sessions

FOLDS = 5


def labelled_pairs(real: DataFrame, synthetic: DataFrame, group: str, groups: list) -> DataFrame:
    """(group, label, row_id, features_flat): the real rows meet each synthetic group.

    ``real`` holds (row_id, features_flat); ``synthetic`` adds the group column. The
    groups are a short list of names.
    """
    copies = F.explode(F.array(*[F.lit(g) for g in groups]))
    a = real.select(copies.alias(group), F.lit(0).alias("label"), "row_id", "features_flat")
    b = synthetic.select(group, F.lit(1).alias("label"), "row_id", "features_flat")
    return a.unionByName(b)


def require_equal_classes(rows: DataFrame, *by: str) -> None:
    """Raise unless all classes, named by the last column of ``by``, have as many rows in each group."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    uneven = sizes.groupBy(*by[:-1]).agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count(F.lit(1)).alias("classes"))
    short = uneven.where("a <> b OR classes < 2").collect()  # one row per group at most
    if short:
        raise ValueError("classes of unequal size: " + ", ".join(map(str, short)))


def with_folds(rows: DataFrame, group: str, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """Stratified folds: a seeded shuffle inside each (group, label), dealt in turn."""
    placed = seeded_order(rows, [group, "label"], "row_id", seed, "__place")
    return placed.withColumn("fold", (F.col("__place") % folds).cast("int")).drop("__place")


def out_of_fold_scores(rows: DataFrame, group: str, groups: list, folds: int = FOLDS) -> DataFrame:
    """Held-out probability of every row, one fit per (group, fold), all fits in the same passes.

    ``rows`` holds (group, label, row_id, fold, features_flat). Both labels must have as many rows.
    """
    require_equal_classes(rows, group, "label")
    return Fits(rows, group, groups, folds).held_out_scores()


def fold_metrics(scores: DataFrame, group: str) -> DataFrame:
    """Mean and population std of AUC and accuracy over the folds."""
    per_fold = fidelity.roc_auc(scores, [group, "fold"])
    return per_fold.groupBy(group).agg(
        F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_std"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
    )


def holdout_report(scores: DataFrame, group: str) -> DataFrame:
    """AUC, accuracy, precision and recall of one held-out part."""
    hit = F.col("score") >= 0.5
    n = lambda cond: F.sum(cond.cast("int"))
    counts = scores.groupBy(group).agg(
        n(hit & (F.col("label") == 1)).alias("tp"), n(hit).alias("p"), n(F.col("label") == 1).alias("pos")
    )
    return fidelity.roc_auc(scores, [group]).join(counts, group).select(
        group, "n", "roc_auc", "accuracy",
        F.try_divide("tp", "p").alias("precision"), F.try_divide("tp", "pos").alias("recall"),
    )


def discriminative_score(rows: DataFrame, group: str, groups: list, components: int = 20, share: float = 0.3) -> DataFrame:
    """|accuracy - 0.5| of a logistic fit on leading components, 30 % held out.

    Folds of ten: three are held out. ``rows`` holds (group, label, row_id, fold, features_flat).
    """
    held = round(share * 10)
    parted = rows.withColumn("fold", F.when(F.col("fold") < held, 0).otherwise(1))
    out = Fits(parted, group, groups, 1, components).held_out_scores()
    hit = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    return out.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")).withColumn(
        "score", F.abs(F.col("accuracy") - 0.5)
    )


def pca_embedding(windows: DataFrame, keep: list[str], k: int = 2, first: int = 30) -> DataFrame:
    """Joint 2-D projection: standardize, keep ``first`` components, report ``k``."""
    rows = windows.select(*keep, array_to_vector("features_flat").alias("x"))
    scaled = StandardScaler(inputCol="x", outputCol="s", withMean=True).fit(rows).transform(rows)
    model = PCA(k=first, inputCol="s", outputCol="z").fit(scaled)
    z = vector_to_array("z")
    cols = [F.get(z, F.lit(j)).alias(f"pc{j + 1}") for j in range(k)]
    return model.transform(scaled).select(*keep, *cols)


def channel_shares(windows: DataFrame, proto: Protocol = PROTOCOL) -> DataFrame:
    """Loadings and squared shares of the channels in their components, largest first.

    Components of standardized channels are those of their correlations, which one aggregation
    gives. A component's sign is the one that makes its largest loading positive.
    """
    names = proto.channels
    steps = sessions(windows, [], proto)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = steps.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]).first()
    r = np.eye(len(names))
    for k, (a, b) in enumerate(pairs):
        r[names.index(a), names.index(b)] = r[names.index(b), names.index(a)] = row[k]
    values, pc = np.linalg.eigh(r)
    values, pc = values[::-1], pc[:, ::-1]
    pc = pc * np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(len(names))])
    rows = [
        (f"pc{j + 1}", c, float(pc[i, j]), float(pc[i, j] ** 2), float(values[j] / len(names)))
        for j in range(len(names))
        for i, c in enumerate(names)
    ]
    return windows.sparkSession.createDataFrame(
        rows, "component string, channel string, loading double, share double, explained_ratio double"
    )
