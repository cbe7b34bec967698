"""Gaussian mixtures by expectation and maximization, several starts in one pass of the rows each.

A pass sends the current components to the tasks. Each task returns, for every start that is
still open, the log-likelihood and the weighted counts, sums and products of its rows, and Spark
adds them; the driver holds components only. Covariances get their floor in every maximization,
as part of the model whose likelihood is followed, and the likeliest start is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .logit import FAN_IN, _SUMS, _added, _sums

#: Rows that a task weighs at a time.
_STEP = 4096


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    #: Mean log-likelihood of a row, after each pass.
    history: list[float]


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """(rows, components): the log of each component's weight times its density."""
    out = np.empty((len(x), len(weights)))
    for k, (w, m, c) in enumerate(zip(weights, means, covariances)):
        root = np.linalg.cholesky(c)
        z = np.linalg.solve(root, (x - m).T)
        out[:, k] = np.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def expectation(x: np.ndarray, model: tuple) -> np.ndarray:
    """Log-likelihood, counts, sums and products of the rows, flat."""
    log = log_densities(x, *model)
    top = log.max(axis=1, keepdims=True)
    whole = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
    share = np.exp(log - whole[:, None])
    products = np.einsum("nk,ni,nj->kij", share, x, x, optimize=True)
    return np.concatenate([[whole.sum(), len(x)], share.sum(axis=0), (share.T @ x).ravel(), products.ravel()])


def maximization(sums: np.ndarray, k: int, floor: float) -> tuple[float, tuple]:
    """(mean log-likelihood of the model that gave the sums, the next model)."""
    d = round((np.sqrt(1 + 4 * (sums.size - 2 - k) / k) - 1) / 2)
    n, counts = sums[1], sums[2 : 2 + k] + 10 * np.finfo(float).eps
    means = sums[2 + k : 2 + k + k * d].reshape(k, d) / counts[:, None]
    second = sums[2 + k + k * d :].reshape(k, d, d) / counts[:, None, None]
    covariances = second - np.einsum("ki,kj->kij", means, means)
    covariances = (covariances + covariances.transpose(0, 2, 1)) / 2 + floor * np.eye(d)
    return sums[0] / n, (counts / n, means, covariances)


def starting_points(rows: DataFrame, row_id: str, vec: str, k: int, seed: int) -> np.ndarray:
    """k rows apart from each other, of 32 k rows by hash: the farthest one from those chosen, each time."""
    few = rows.orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(32 * k).select(vec).collect()
    x = np.array([r[0] for r in few], dtype=float)
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        # Half-way out, so that single rows far off are no starts.
        order = np.argsort(far, kind="stable")
        chosen.append(int(order[len(order) - 1 - len(order) // 4]))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def fit(
    rows: DataFrame, row_id: str, vec: str, k: int, seed: int, starts: int = 2, floor: float = 1e-4, tolerance: float = 1e-3, max_passes: int = 500,
    means: list[np.ndarray] | None = None,
) -> Mixture:
    """The likeliest of ``starts`` fits of ``rows`` (staged, as each pass reads them)."""
    spark = rows.sparkSession
    begin = means or [starting_points(rows, row_id, vec, k, seed + s) for s in range(starts)]
    d = begin[0].shape[1]
    centre = np.mean(begin[0], axis=0)
    # One component of all rows gives the spread that every start begins with.
    one = _pass(rows.select(vec), spark, centre, {0: (np.ones(1), np.zeros((1, d)), np.eye(d)[None])})[0]
    _, (_, _, whole) = maximization(one, 1, floor)
    models = {s: (np.full(len(m), 1 / len(m)), m - centre, np.repeat(whole, len(m), axis=0)) for s, m in enumerate(begin)}
    history: dict[int, list[float]] = {s: [] for s in models}
    open_ = set(models)
    for _ in range(max_passes):
        for s, sums in _pass(rows.select(vec), spark, centre, {s: models[s] for s in sorted(open_)}).items():
            value, following = maximization(sums, len(models[s][0]), floor)
            history[s].append(value)
            if len(history[s]) > 1 and abs(value - history[s][-2]) < tolerance:
                open_.discard(s)
            else:
                models[s] = following
        if not open_:
            break
    best = max(history, key=lambda s: (history[s][-1], -s))
    weights, at, covariances = models[best]
    return Mixture(weights, at + centre, covariances, history[best])


def _pass(rows: DataFrame, spark, centre: np.ndarray, models: dict[int, tuple]) -> dict[int, np.ndarray]:
    """The sums of every model: counts, sums and products of its components, whatever the rows."""
    shared = spark.sparkContext.broadcast((centre, models))

    def expect(batches):
        centre, models = shared.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1) - centre
            for at in range(0, len(x), _STEP):
                for s, model in models.items():
                    part = expectation(x[at : at + _STEP], model)
                    total[s] = total[s] + part if s in total else part
        if total:
            yield _sums([(s, 0, t) for s, t in total.items()])

    parts = rows.mapInArrow(expect, _SUMS).withColumn("part", F.spark_partition_id() % FAN_IN)
    out = {r.model: np.frombuffer(r.sums) for r in _added(_added(parts, sum, "part"), sum).collect()}
    shared.unpersist()
    return out
