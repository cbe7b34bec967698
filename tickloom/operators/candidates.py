"""The named grid of resampling candidates, one job per family."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from ..functions import hashrand
from ..session import stage
from . import mixture, resample


@dataclass(frozen=True)
class Candidate:
    name: str
    family: str
    sigma: float = 0.0
    rho: float = 0.0
    components: int = 0
    clusters: int = 0


# The candidates as (name, family, noise scale, time correlation, components, clusters).
GRID: tuple[Candidate, ...] = tuple(
    Candidate(*row)
    for row in (
        ("baseline_jitter_0p05", "bootstrap_independent", 0.05, 0.0, 0, 0),
        ("bootstrap_jitter_0p02", "bootstrap_independent", 0.02, 0.0, 0, 0),
        ("bootstrap_jitter_0p075", "bootstrap_independent", 0.075, 0.0, 0, 0),
        ("bootstrap_jitter_0p10", "bootstrap_independent", 0.10, 0.0, 0, 0),
        ("bootstrap_jitter_0p125", "bootstrap_independent", 0.125, 0.0, 0, 0),
        ("bootstrap_jitter_0p15", "bootstrap_independent", 0.15, 0.0, 0, 0),
        ("correlated_jitter_0p10", "bootstrap_temporal", 0.10, 0.0, 0, 0),
        ("correlated_jitter_0p125", "bootstrap_temporal", 0.125, 0.0, 0, 0),
        ("temporal_jitter_0p03_rho0p85", "bootstrap_temporal", 0.03, 0.85, 0, 0),
        ("temporal_jitter_0p05_rho0p85", "bootstrap_temporal", 0.05, 0.85, 0, 0),
        ("temporal_jitter_0p075_rho0p85", "bootstrap_temporal", 0.075, 0.85, 0, 0),
        ("temporal_jitter_0p10_rho0p85", "bootstrap_temporal", 0.10, 0.85, 0, 0),
        ("temporal_jitter_0p10_rho0p65", "bootstrap_temporal", 0.10, 0.65, 0, 0),
        ("temporal_jitter_0p10_rho0p95", "bootstrap_temporal", 0.10, 0.95, 0, 0),
        ("temporal_jitter_0p125_rho0p85", "bootstrap_temporal", 0.125, 0.85, 0, 0),
        ("temporal_jitter_0p15_rho0p85", "bootstrap_temporal", 0.15, 0.85, 0, 0),
        ("temporal_jitter_0p175_rho0p85", "bootstrap_temporal", 0.175, 0.85, 0, 0),
        ("temporal_jitter_0p20_rho0p85", "bootstrap_temporal", 0.20, 0.85, 0, 0),
        ("temporal_jitter_0p25_rho0p85", "bootstrap_temporal", 0.25, 0.85, 0, 0),
        ("temporal_jitter_0p30_rho0p85", "bootstrap_temporal", 0.30, 0.85, 0, 0),
        ("temporal_jitter_0p40_rho0p85", "bootstrap_temporal", 0.40, 0.85, 0, 0),
        ("temporal_jitter_0p50_rho0p85", "bootstrap_temporal", 0.50, 0.85, 0, 0),
        ("regime_temporal_jitter_0p03_rho0p85", "regime_bootstrap_temporal", 0.03, 0.85, 0, 0),
        ("regime_temporal_jitter_0p05_rho0p85", "regime_bootstrap_temporal", 0.05, 0.85, 0, 0),
        ("regime_temporal_jitter_0p075_rho0p85", "regime_bootstrap_temporal", 0.075, 0.85, 0, 0),
        ("regime_temporal_jitter_0p10_rho0p85", "regime_bootstrap_temporal", 0.10, 0.85, 0, 0),
        ("regime_mixup_jitter_0p01_rho0p85", "regime_neighbor_mixup_temporal", 0.01, 0.85, 0, 0),
        ("regime_mixup_jitter_0p02_rho0p85", "regime_neighbor_mixup_temporal", 0.02, 0.85, 0, 0),
        ("regime_mixup_jitter_0p03_rho0p85", "regime_neighbor_mixup_temporal", 0.03, 0.85, 0, 0),
        ("pca_gmm_24c8", "pca_gmm", 0.0, 0.0, 24, 8),
        ("pca_gmm_32c12", "pca_gmm", 0.0, 0.0, 32, 12),
    )
)


def jitter_family(base: DataFrame, seed: int, specs: list[Candidate], chol: Column | None, proto: Protocol = PROTOCOL) -> DataFrame:
    """All candidates of one family from one set of base windows and normals.

    ``base`` holds (synthetic_id, features_flat). Noise is drawn once per window and
    time correlation, then scaled by each spec.
    """
    if chol is None:
        noisy = base.withColumn("noise_0", hashrand.normals(F.col("synthetic_id"), seed, proto.width))
        rhos = (0.0,)
    else:
        rhos = tuple(sorted({s.rho for s in specs}))
        noisy = resample.temporal_noise(base, seed, chol, rhos, proto)
    rows = F.array(
        *[F.struct(F.lit(s.name).alias("name"), F.lit(s.family).alias("family"), F.lit(s.sigma).alias("sigma"), F.lit(rhos.index(s.rho)).alias("k")) for s in specs]
    )
    spread = noisy.withColumn("__spec", F.explode(rows))
    noise = F.lit(None).cast("array<double>")
    for k in range(len(rhos)):
        noise = F.when(F.col("__spec.k") == k, F.col(f"noise_{k}")).otherwise(noise)
    spread = spread.withColumn("__n", noise).withColumn("__s", F.col("__spec.sigma"))
    added = F.zip_with("features_flat", "__n", lambda x, n: x + F.col("__s") * n)
    return spread.select(
        F.col("__spec.name").alias("method"), F.col("__spec.family").alias("family"), "synthetic_id", added.alias("features_flat")
    )


def pca_gmm(donors: DataFrame, spec: Candidate, n: int, seed: int, proto: Protocol = PROTOCOL, max_iter: int = 500, starts: int = 2) -> DataFrame:
    """Gaussian mixture in PCA space, sampled and mapped back.

    The likelier of ``starts`` fits is kept; covariances have their floor in every step. Only the
    model (at most 32 x 195 loadings and 12 small covariances) is held by the tasks that sample.
    """
    width = proto.width
    centred = donors.select("donor_idx", array_to_vector("features_flat").alias("x"))
    mean = np.array(donors.agg(F.array(*[F.avg(F.get("features_flat", F.lit(i))) for i in range(width)])).first()[0])
    pca = PCA(k=min(spec.components, width), inputCol="x", outputCol="z").fit(centred)
    latent = stage(pca.transform(centred).select("donor_idx", vector_to_array("z").alias("z")), "latent")
    fitted = mixture.fit(latent, "donor_idx", "z", spec.clusters, seed, starts, max_passes=max_iter)
    loadings = pca.pc.toArray()
    weights, means = np.cumsum(fitted.weights), fitted.means
    roots = np.linalg.cholesky(fitted.covariances)
    # PCA scores are taken about the origin, so the mixture carries the mean already
    # inside the retained subspace; the rest of the mean is added back here.
    rest = mean - loadings @ (loadings.T @ mean)
    tasks = max(donors.sparkSession.sparkContext.defaultParallelism, n // resample.DRAWS_PER_TASK)
    ids = donors.sparkSession.range(0, n, 1, tasks).withColumnRenamed("id", "synthetic_id")
    drawn = ids.select(
        "synthetic_id",
        hashrand.uniform(F.col("synthetic_id"), seed, "cluster").alias("u"),
        hashrand.normals(F.col("synthetic_id"), seed, loadings.shape[1]).alias("z"),
    )

    def sample(batches):
        for batch in batches:
            u = np.asarray(batch.column(1))
            z = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            cluster = np.minimum(np.searchsorted(weights, u), len(means) - 1)
            points = np.empty_like(z)
            for c in np.unique(cluster):
                rows = cluster == c
                points[rows] = means[c] + z[rows] @ roots[c].T
            flat = points @ loadings.T + rest
            arrays = [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), width).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["synthetic_id", "features_flat"])

    made = drawn.mapInArrow(sample, "synthetic_id long, features_flat array<double>")
    return made.select(F.lit(spec.name).alias("method"), F.lit(spec.family).alias("family"), "synthetic_id", "features_flat")
