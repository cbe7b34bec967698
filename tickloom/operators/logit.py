"""Many L2 logistic regressions side by side, by Newton steps over one pass of the rows each.

Rows carry a group and a fold; model (group, f) trains on the group's rows of all other folds, so
one row serves every model it trains. A pass sends the current weights to the tasks, each task
returns one gradient and Hessian per model it has rows of, and these are added and solved in a
task per model: the driver holds weights only, whatever the number of rows. Rows are staged in
order of group, so a task has few models and the sums that travel are about as many as
models plus tasks. Sums of many tasks are added in two levels.

Features of a model are standardized by its training rows' mean and population deviation, or
mapped to their leading principal components. The intercept is not penalized, and the penalty is
half the squared length of the weights beside the summed loss (C = 1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage

#: Rows a task of a pass takes, in the mean, and sums that one task adds.
ROWS_PER_TASK, FAN_IN = 8_000, 64
MAX_PASSES = 30
#: A model is done when a full step would lower its objective by less than this share of it.
TOLERANCE = 1e-13
_SUMS = "model int, part int, sums binary"


def _sums(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["model", "part", "sums"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(group, fold, labels, features, batch, rows of it) of each group and fold in each batch."""
    for batch in batches:
        group, fold, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        order = np.lexsort((fold, group))
        cuts = np.flatnonzero((np.diff(group[order]) != 0) | (np.diff(fold[order]) != 0)) + 1
        for at in np.split(order, cuts) if batch.num_rows else ():
            yield int(group[at[0]]), int(fold[at[0]]), label[at].astype(np.float64), x[at], batch, at


def _added(parts: DataFrame, add: Callable, *by: str) -> DataFrame:
    """One row of sums per model (and part); ``add`` adds the flat sums of a list."""

    def some(rows: pa.Table) -> pa.Table:
        total = add([np.frombuffer(s.as_py()) for s in rows.column("sums")])
        return pa.Table.from_batches([_sums([(rows.column("model")[0].as_py(), rows.column("part")[0].as_py(), total)])])

    return parts.groupBy("model", *by).applyInArrow(some, _SUMS)


def _moments(flat: list[np.ndarray]) -> np.ndarray:
    """Count, mean and centred products of several parts, by pairwise updates."""
    total = flat[0].copy()
    width = _width(total.size - 1)
    for part in flat[1:]:
        n = total[0] + part[0]
        apart = part[1 : width + 1] - total[1 : width + 1]
        total[width + 1 :] += part[width + 1 :] + (np.outer(apart, apart) * (total[0] * part[0] / n)).ravel()
        total[1 : width + 1] += apart * (part[0] / n)
        total[0] = n
    return total


def _width(size: int) -> int:
    """The w of w + w * w = size."""
    return round((np.sqrt(4 * size + 1) - 1) / 2)


class Fits:
    """Models (group, held-out fold) over rows of (group, label, row_id, fold, features_flat).

    ``groups`` is a short list of names, and ``folds`` models are fitted of each.
    """

    def __init__(self, rows: DataFrame, group: str, groups: list, folds: int, components: int | None = None):
        self.group, self.groups, self.folds = group, groups, folds
        place = F.array_position(F.array(*map(F.lit, groups)), F.col(group)).cast("int") - 1
        own = rows.select(place.alias("g"), F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), "features_flat", group, "row_id")
        n = rows.count()
        tasks = max(1, -(-n // ROWS_PER_TASK))
        self.rows = stage(own.repartitionByRange(tasks, "g", "row_id"), "fit-rows") if tasks > 1 else stage(own.coalesce(1), "fit-rows")
        self.several = tasks > FAN_IN
        self.models = [(g, f) for g in range(len(groups)) for f in range(folds)]
        self.maps = self._maps(components)
        self.passes = 0
        self.weights = self._newton()

    def _fanned(self, parts: DataFrame, add: Callable) -> DataFrame:
        """The sums of many tasks, added to FAN_IN per model."""
        return _added(parts.withColumn("part", F.spark_partition_id() % FAN_IN), add, "part") if self.several else parts

    def _maps(self, components: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(shift, map) of each model's features, from the moments of each group and fold."""
        folds = self.rows.agg(F.max("fold")).first()[0]
        many = (folds or 0) + 1

        def moments(batches):
            held: dict[int, list] = {}
            for g, f, _, x, *_ in _blocks(batches):
                mean = x.mean(axis=0)
                part = np.concatenate([[len(x)], mean, ((x - mean).T @ (x - mean)).ravel()])
                held[g * many + f] = [_moments([*held.get(g * many + f, []), part])]
            if held:
                yield _sums([(m, m, s[0]) for m, s in held.items()])

        parts = self.rows.select("g", "fold", "label", "features_flat").mapInArrow(moments, _SUMS)
        # One row per group and fold: a mean and a matrix of the features, whatever the rows.
        found = {r.model: np.frombuffer(r.sums) for r in _added(self._fanned(parts, _moments), _moments).collect()}
        out = []
        for g, f in self.models:
            parts = [found[m] for m in sorted(found) if m // many == g and m % many != f]
            if not parts:
                raise ValueError(f"no training rows for {self.groups[g]}, fold {f}")
            train = _moments(parts)
            width = _width(train.size - 1)
            mean, spread = train[1 : width + 1], train[width + 1 :].reshape(width, width) / train[0]
            if components is None:
                scale = np.sqrt(np.diag(spread))
                out.append((mean, np.divide(1.0, scale, out=np.zeros(width), where=scale > 0)))
            else:
                own = np.linalg.eigh(spread)[1][:, ::-1]
                out.append((mean, own[:, : min(components, width, int(train[0]) - 1)]))
        return out

    def _newton(self) -> list[np.ndarray]:
        folds, spark = self.folds, self.rows.sparkSession
        size = [(m[1].shape[-1] if m[1].ndim == 2 else m[1].size) + 1 for m in self.maps]
        weights = [np.zeros(k) for k in size]
        before, step = [np.inf] * len(size), [np.zeros(k) for k in size]
        open_ = set(range(len(size)))
        while open_ and self.passes < MAX_PASSES:
            self.passes += 1
            shared = spark.sparkContext.broadcast((self.maps, weights, open_.copy()))

            def derivatives(batches):
                maps, now, wanted = shared.value
                held: dict[int, np.ndarray] = {}
                for g, f, y, x, *_ in _blocks(batches):
                    for m in range(g * folds, (g + 1) * folds):
                        if m - g * folds != f and m in wanted:
                            z, p = _probabilities(x, maps[m], now[m])
                            margin = np.where(y == 1, 1, -1) * (z @ now[m])
                            sums = np.concatenate([[np.logaddexp(0, -margin).sum()], z.T @ (p - y), (z.T @ (z * (p * (1 - p))[:, None])).ravel()])
                            held[m] = held[m] + sums if m in held else sums
                if held:
                    yield _sums([(m, 0, s) for m, s in held.items()])

            def solve(rows: pa.Table) -> pa.Table:
                m = rows.column("model")[0].as_py()
                total, w = sum(np.frombuffer(s.as_py()) for s in rows.column("sums")), shared.value[1][m]
                penalty = np.append(np.ones(w.size - 1), 0.0)
                gradient = total[1 : w.size + 1] + penalty * w
                hessian = total[w.size + 1 :].reshape(w.size, w.size) + np.diag(penalty)
                # The intercept has no penalty: a little on the diagonal keeps a one-sided model solvable.
                move = np.linalg.solve(hessian + np.diag(1e-10 * (penalty == 0)), -gradient)
                value = total[0] + 0.5 * (penalty * w * w).sum()
                return pa.Table.from_batches([_sums([(m, 0, np.concatenate([[value, -0.5 * gradient @ move], move]))])])

            parts = self.rows.select("g", "fold", "label", "features_flat").mapInArrow(derivatives, _SUMS)
            parts = self._fanned(parts, sum)
            for r in parts.groupBy("model").applyInArrow(solve, _SUMS).collect():  # one row of weights a model
                m, (value, gain, *move) = r.model, np.frombuffer(r.sums)
                if value > before[m] + 1e-9 * abs(before[m]):  # too far: half the last step back
                    step[m] = step[m] / 2
                    weights[m] = weights[m] - step[m]
                    continue
                before[m], step[m] = value, np.array(move)
                weights[m] = weights[m] + step[m]
                if gain <= TOLERANCE * max(1.0, abs(value)):
                    open_.discard(m)
            shared.unpersist()
        if open_:
            raise ArithmeticError(f"{len(open_)} of {len(size)} logistic fits are open after {MAX_PASSES} passes")
        return weights

    def held_out_scores(self) -> DataFrame:
        """(group, label, row_id, fold, score): the probability of label 1 by the model that held the row out."""
        shared = self.rows.sparkSession.sparkContext.broadcast((self.maps, self.weights))
        folds, name = self.folds, self.group
        types = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        schema = f"{name} {types[name]}, label int, row_id {types['row_id']}, fold int, score double"

        def score(batches):
            maps, weights = shared.value
            for g, f, _, x, batch, at in _blocks(batches):
                if f < folds:
                    p = _probabilities(x, maps[g * folds + f], weights[g * folds + f])[1]
                    columns = [batch.column(k).take(pa.array(at)) for k in (4, 2, 5, 1)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(p)], names=[name, "label", "row_id", "fold", "score"])

        return stage(self.rows.mapInArrow(score, schema), "held-out")


def _probabilities(x: np.ndarray, how: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mapped features with a one behind them, and the probability of label 1."""
    shift, scale = how
    z = (x - shift) * scale if scale.ndim == 1 else (x - shift) @ scale
    z = np.column_stack([z, np.ones(len(z))])
    return z, 0.5 * (1 + np.tanh(0.5 * (z @ w)))
