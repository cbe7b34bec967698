"""The neighbour embedding against a direct one, and against principal components."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import embed


def walks(seed, n):
    return np.random.default_rng(seed).normal(size=(n, 65, 3)).cumsum(axis=1).reshape(n, -1)


def components(x):
    c = x - x.mean(0)
    return c @ np.linalg.svd(c, full_matrices=False)[2][:2].T


def trust(x, y, k=10):
    """Share of neighbours in the picture that are neighbours in the data, by ranks."""
    far = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) + np.diag(np.full(len(z), np.inf))
    rank = far(x).argsort(1).argsort(1) + 1
    near = far(y).argsort(1)[:, :k]
    n = len(x)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


def tables(spark, x):
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "i long, vec array<double>").repartition(4)
    start = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(components(x))], "i long, x double, y double")
    return rows, start


def drawn(i, turn, s, n):
    word = int(hashlib.md5(f"{i}:42:repel:{turn}:{s}".encode()).hexdigest()[:8], 16)
    return int((word + 0.5) / 2**32 * n)


def direct(x, k, rounds):
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    p = embed.affinities(np.take_along_axis(d, near, 1), min(embed.PERPLEXITY, k / 3))
    w = np.zeros((n, n))
    for i in range(n):
        w[i, near[i]] += p[i] / 2
        w[near[i], i] += p[i] / 2
    y = components(x)
    y = y / y.std(0) * 0.1 * np.sqrt(n)
    crowd = None
    for turn in range(rounds):
        early = turn < embed.EARLY_SHARE * rounds
        rate = embed.RATE * (1 if early else 1 - (turn - embed.EARLY_SHARE * rounds) / (rounds * (1 - embed.EARLY_SHARE)))
        others = np.array([[drawn(i, turn, s, n) for s in range(embed.DRAWS)] for i in range(n)])
        apart = y[others] - y[:, None]
        q = 1 / (1 + (apart**2).sum(2))
        crowd = q.mean() if crowd is None else crowd
        gap = y[None] - y[:, None]
        pull = ((embed.EARLY if early else 1) * w / (1 + (gap**2).sum(2)))[:, :, None] * gap
        move = 4 * rate * (pull.sum(1) - ((q**2)[:, :, None] * apart).sum(1) / (embed.DRAWS * crowd))
        crowd = q.mean()
        y = y + move / np.maximum(1, np.sqrt((move**2).sum(1, keepdims=True)) / embed.LONGEST)
    return y


def test_weights_have_the_perplexity():
    d = np.random.default_rng(1).random((50, 30)) * np.arange(1, 51)[:, None]
    p = embed.affinities(d, 8.0)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-(p * np.log(p)).sum(1)), 8.0, rtol=1e-6)


def test_rounds_equal_a_direct_version(spark):
    x = walks(2, 60)
    rows, start = tables(spark, x)
    edges = embed.neighbour_graph(rows, "i", "vec", k=12)
    got = {r.i: (r.x, r.y) for r in embed.embed(edges, start, 60, rounds=5).collect()}
    assert np.allclose([got[k] for k in range(60)], direct(x, 12, 5), atol=1e-5)


def test_embedding_keeps_neighbours_better_than_components(spark):
    x = walks(3, 300)
    rows, start = tables(spark, x)
    edges = embed.neighbour_graph(rows, "i", "vec")
    first = {r.i: (r.x, r.y) for r in embed.embed(edges, start, 300, rounds=25).collect()}
    again = {r.i: (r.x, r.y) for r in embed.embed(edges.repartition(3), start.repartition(2), 300, rounds=25).collect()}
    assert first == again
    assert trust(x, np.array([first[k] for k in range(300)])) > trust(x, components(x)) + 0.02


def test_graph_has_both_directions(spark):
    rows, _ = tables(spark, walks(4, 40))
    edges = embed.neighbour_graph(rows, "i", "vec", k=5)
    assert edges.agg(F.sum("w")).first()[0] > 39.999 and edges.where("i = j").count() == 0
    both = edges.groupBy("i", "j").agg(F.sum("w").alias("w"))
    assert both.join(both.toDF("j", "i", "v"), ["i", "j"]).where("abs(w - v) > 1e-12").count() == 0
