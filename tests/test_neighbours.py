"""Exact neighbours: far from the origin, over many blocks, through pivots, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import clean, explore, splits
from tickloom.operators import neighbours
from tickloom.operators.neighbours import Cells, block_nearest, nearest


def frame(spark, x, name):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{name} long, vec array<double>")


def brute(q, t, k, skip=False):
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(2))
    if skip:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("offset", [0.0, 1e7, 1e12])
def test_blocks_are_exact_far_from_the_origin(offset):
    rng = np.random.default_rng(1)
    t = offset + np.round(rng.normal(size=(300, 30)), 3)
    q = np.concatenate([offset + np.round(rng.normal(size=(40, 30)), 3), t[:10], np.repeat(t[:1], 5, axis=0)])
    _, got = block_nearest(q, t, 3, None)
    assert (got == brute(q, t, 3)).all()


def test_ties_everywhere_are_exact():
    t = np.zeros((500, 4))
    _, got = block_nearest(t[:7], t, 4, None)
    assert (got == 0).all()


@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("prune_from", [1, 10**9])
def test_both_ways_agree_with_brute_force(spark, skip, prune_from):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 50
    x = np.concatenate([c + rng.normal(size=(60, 8)) for c in centres] + [np.array([[1e4] * 8])])
    table = frame(spark, x, "a")
    found = nearest(table, table.withColumnRenamed("a", "b"), [], "a", "b", 3, skip_same_id=skip, block_rows=100, prune_from=prune_from)
    got = {}
    for r in found.collect():
        got.setdefault(r.a, {})[r["rank"]] = r.distance
    want = brute(x, x, 3, skip)
    assert len(got) == len(x)
    for a, ranks in got.items():
        assert [ranks[r] for r in (1, 2, 3)] == pytest.approx(want[a].tolist(), rel=1e-12)


def test_fewer_targets_than_neighbours(spark):
    x = np.arange(6.0).reshape(3, 2)
    for prune_from in (1, 99):
        found = nearest(frame(spark, x, "a"), frame(spark, x, "b"), [], "a", "b", 5, skip_same_id=True, prune_from=prune_from)
        assert found.groupBy("a").count().where("count = 2").count() == 3


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_join_in_any_plan(spark, no_broadcast):
    table = frame(spark, np.random.default_rng(3).normal(size=(50, 4)), "a")
    for prune_from in (1, 99):
        plan = plan_of(nearest(table, table.withColumnRenamed("a", "b"), [], "a", "b", 2, prune_from=prune_from))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    keyed = table.withColumn("regime", F.col("a") % 3)
    plan = plan_of(nearest(keyed, keyed.withColumnRenamed("a", "b"), ["regime"], "a", "b", 2))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan


def test_no_join_or_window_on_a_hot_key_alone(spark, no_broadcast):
    rows = [(f"T{k % 3}", f"1995-01-{1 + k % 28:02d}", 10.0, 11.0, 9.0, 10.0 + k % 5, 1.0) for k in range(84)]
    panel = spark.createDataFrame(rows, "ticker string, d string, open double, high double, low double, close double, volume double")
    panel = panel.withColumn("date", F.to_date("d")).drop("d")
    for df in (clean.drop_low_coverage(panel), explore.box_stats(panel, ["ticker"], "close")):
        plan = plan_of(df)
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    plan = plan_of(splits.with_daily_row(panel))
    assert "SortMergeJoin" not in plan and "windowspecdefinition(year" not in plan
    assert [r.daily_row for r in splits.with_daily_row(panel).orderBy("date", "ticker").collect()] == list(range(84))


# --- the index of lower bounds -----------------------------------------------------------------


def walks(seed, n, steps=65, channels=3):
    """Windows of random walks: no clusters, and most of their spread in few directions."""
    return np.random.default_rng(seed).normal(size=(n, steps, channels)).cumsum(axis=1).reshape(n, -1)


def grouped(df, name, vec="vec"):
    return df.select(F.lit(0).alias("group"), F.col(name), vec)


def test_index_on_walks_is_exact_and_leaves_most_out(spark):
    """At most a tenth of the (query, cell) pairs, so of the vectors sent, on data without clusters."""
    x = walks(4, 6000)
    q, t = frame(spark, x[:1500], "a"), frame(spark, x[1500:], "b")
    cells = Cells(grouped(q, "a"), grouped(t, "b"), "a", "b", 1, "vec", False, 4096, cell_rows=32)
    n_cells = cells.held.select("cell").distinct().count()
    sent = cells.first.select(F.sum(F.size("cells"))).first()[0] + cells.more.count()
    assert n_cells > 100 and sent <= 0.1 * 1500 * n_cells
    best = cells.found().groupBy("a").agg(F.min("distance").alias("d")).collect()
    want = brute(x[:1500], x[1500:], 1)[:, 0]
    assert len(best) == 1500 and all(r.d == pytest.approx(want[r.a], rel=1e-12) for r in best)


def test_keyed_index_is_exact(spark, monkeypatch):
    """Large groups by k-d cells, small ones whole, with ties, copies and a group on one side alone."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 6)), 1)
    regime = np.where(np.arange(700) < 400, 0, np.where(np.arange(700) < 650, 1, np.arange(700) % 3 + 2))
    rows = [(k, int(r), v.tolist()) for k, (r, v) in enumerate(zip(regime, x))] + [(5000, 99, [0.0] * 6)]
    table = spark.createDataFrame(rows, "a long, regime int, vec array<double>")
    other = table.where("regime < 99").withColumnRenamed("a", "b")
    got = {}
    for r in nearest(table, other, ["regime"], "a", "b", 12, skip_same_id=True, block_rows=64, prune_from=4).collect():
        got.setdefault(r.a, {})[r["rank"]] = (r.b, r.distance)
    for k in range(700):
        mates = np.flatnonzero((regime == regime[k]) & (np.arange(700) != k))
        d = np.sqrt(((x[mates] - x[k]) ** 2).sum(1))
        want = sorted(zip(d, mates))[:12]
        assert [got[k][r + 1][1] for r in range(len(want))] == pytest.approx([w[0] for w in want], rel=1e-12, abs=1e-12)
        assert [got[k][r + 1][0] for r in range(len(want))] == [w[1] for w in want]  # ties by id
    assert 5000 not in got


def test_cells_searched_grow_slowly(spark):
    """Twice the rows, not much more than twice the visits: near n log n, not n squared."""
    visits = []
    for n in (2000, 4000):
        rng = np.random.default_rng(6)
        table = frame(spark, rng.normal(size=(n, 6)), "a")
        cells = Cells(grouped(table, "a"), grouped(table.withColumnRenamed("a", "b"), "b"), "a", "b", 12, "vec", True, 4096, cell_rows=64)
        visits.append(cells.first.select(F.sum(F.size("cells"))).first()[0] + cells.more.count())
    assert visits[1] <= 2.9 * visits[0]


def test_index_of_equal_rows(spark):
    x = np.ones((300, 20))
    found = nearest(frame(spark, x, "a"), frame(spark, x, "b"), [], "a", "b", 2, skip_same_id=True, block_rows=50, prune_from=1)
    got = found.collect()
    assert len(got) == 600 and all(r.distance == 0 and r.a != r.b for r in got)
