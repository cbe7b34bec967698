"""A neighbour embedding in two dimensions: near rows attract along a graph, all rows repel.

The graph has each row's nearest rows, weighted so that their perplexity is the same for every
row. Positions begin at the principal components and move in rounds: along every edge by the
heavy-tailed force of the embedding, and away from a few rows drawn by hash, which stand for all
others. A round is one pass over the edges and one over the draws; positions are staged after
each, and forces are summed as whole numbers, so that a rerun gives the same picture whatever the
order in which its tasks end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import hashrand
from ..session import broadcast_if_small, stage
from .neighbours import matrix, nearest

NEIGHBOURS, PERPLEXITY = 30, 10.0
ROUNDS, DRAWS, RATE = 40, 8, 0.5
#: Attraction is this much stronger in the first share of the rounds; steps are bounded.
EARLY, EARLY_SHARE, LONGEST = 4.0, 0.35, 2.0
_UNITS = 1e9


def affinities(squared: np.ndarray, perplexity: float) -> np.ndarray:
    """(rows, k): weights of each row's neighbours, which sum to one and have the perplexity, by bisection."""
    near = squared - squared.min(axis=1, keepdims=True)
    low, high = np.zeros(len(near)), np.full(len(near), np.inf)
    sharp = 1.0 / np.maximum(near.mean(axis=1), 1e-12)
    for _ in range(60):
        p = np.exp(-near * sharp[:, None])
        p /= p.sum(axis=1, keepdims=True)
        wide = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1) > np.log(perplexity)
        low, high = np.where(wide, sharp, low), np.where(wide, high, sharp)
        sharp = np.where(np.isinf(high), 2 * sharp, (low + high) / 2)
    return p


def neighbour_graph(rows: DataFrame, row_id: str, vec: str, k: int = NEIGHBOURS, perplexity: float = PERPLEXITY) -> DataFrame:
    """(i, j, w): both directions of every edge; the weights of all rows are one in the mean."""
    points = rows.select(F.col(row_id).alias("i"), F.col(vec).alias("vec"))
    near = nearest(points, points.withColumnRenamed("i", "j"), [], "i", "j", k, skip_same_id=True)
    lists = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("distance", "j"))).alias("near"))
    lists = lists.select("i", F.transform("near", lambda x: x["j"]).alias("js"), F.transform("near", lambda x: x["distance"]).alias("ds"))

    def weigh(batches):
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            weights: list = [None] * batch.num_rows
            for size in np.unique(sizes):  # fewer rows than neighbours: all lists are shorter alike
                at = np.flatnonzero(sizes == size)
                d = matrix(pa.chunked_array([batch.column(2).take(pa.array(at))]))
                for row, p in zip(at, affinities(d * d, min(perplexity, max(1.0, size / 3)))):
                    weights[row] = p
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weights, pa.list_(pa.float64()))], names=["i", "js", "ws"])

    pairs = lists.mapInArrow(weigh, "i long, js array<long>, ws array<double>").select("i", F.explode(F.arrays_zip("js", "ws")).alias("e"))
    one = pairs.select("i", F.col("e.js").alias("j"), (F.col("e.ws") / 2).alias("w"))
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def embed(edges: DataFrame, start: DataFrame, n: int, seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """(i, x, y) after ``rounds``. ``start`` holds (i, x, y) with i from 0 to n - 1, ``edges`` (i, j, w)."""
    links = stage(edges.groupBy("i", "j").agg(F.sum(F.round(F.col("w") * _UNITS).cast("long")).alias("w")), "embed-edges")
    spread = start.agg(F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")).first()
    size = 0.1 * np.sqrt(n)
    scaled = [F.round(F.col(c) * F.lit(size / (spread[c] or 1.0)), 9).alias(c) for c in ("x", "y")]
    at = stage(start.select(F.col("i").cast("long").alias("i"), *scaled), "embed-start")
    crowd = None
    for turn in range(rounds):
        early = turn < EARLY_SHARE * rounds
        rate = RATE * (1.0 if early else 1.0 - (turn - EARLY_SHARE * rounds) / (rounds * (1.0 - EARLY_SHARE)))
        if crowd is None:
            crowd = _repel(at, n, seed, 0).agg(F.avg("q")).first()[0] or 1.0
        there = broadcast_if_small(at.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")))
        dx, dy = F.col("xj") - F.col("x"), F.col("yj") - F.col("y")
        pull = links.join(broadcast_if_small(at), "i").join(there, "j")
        force = (EARLY if early else 1.0) * F.col("w") / _UNITS / (1.0 + dx * dx + dy * dy)
        pull = pull.select("i", (force * dx).alias("fx"), (force * dy).alias("fy"), F.lit(None).cast("double").alias("q"))
        push = _repel(at, n, seed, turn)
        push = push.select("i", (-F.col("q") * F.col("q") * F.col("dx") / (DRAWS * crowd)).alias("fx"), (-F.col("q") * F.col("q") * F.col("dy") / (DRAWS * crowd)).alias("fy"), "q")
        units = lambda c: F.sum(F.round(F.col(c) * _UNITS).cast("long"))
        sums = pull.unionByName(push).groupBy("i").agg((units("fx") / _UNITS * 4 * rate).alias("fx"), (units("fy") / _UNITS * 4 * rate).alias("fy"), units("q").alias("q"), F.count("q").alias("m"))
        long = F.greatest(F.lit(1.0), F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")) / LONGEST)
        moved = [F.round(F.col(c) + F.col(f) / long, 9).alias(c) for c, f in (("x", "fx"), ("y", "fy"))]
        at = stage(at.join(sums, "i").select("i", *moved, "q", "m"), "embed-round")
        crowd = (at.agg(F.sum("q") / _UNITS / F.sum("m")).first()[0]) or 1.0
        at = at.select("i", "x", "y")
    return at


def _repel(at: DataFrame, n: int, seed: int, turn: int) -> DataFrame:
    """(i, dx, dy, q) of each row and DRAWS others drawn by hash."""
    draws = F.array(*[F.floor(hashrand.uniform(F.col("i"), seed, f"repel:{turn}:{s}") * n).cast("long") for s in range(DRAWS)])
    there = broadcast_if_small(at.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")))
    met = at.select("i", "x", "y", F.explode(draws).alias("j")).join(there, "j")
    dx, dy = F.col("xj") - F.col("x"), F.col("yj") - F.col("y")
    return met.select("i", dx.alias("dx"), dy.alias("dy"), (1.0 / (1.0 + dx * dx + dy * dy)).alias("q"))
