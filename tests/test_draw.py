"""Draws by threshold against a sort of the same hashes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tickloom.operators import draw, fidelity


def in_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}:order".encode()).hexdigest(), i))


@pytest.mark.parametrize("digits, passes", [(4, 2), (1, 1), (1, 3)])
def test_same_rows_as_a_sort(spark, monkeypatch, digits, passes):
    monkeypatch.setattr(draw, "DIGITS", digits)
    monkeypatch.setattr(draw, "PASSES", passes)
    rows = [(k % 3, k) for k in range(900)] + [(7, 1), (7, 2)]
    df = spark.createDataFrame(rows, "g int, id long").repartition(4)
    wanted = F.when(F.col("g") == 1, F.array(F.lit(1), F.lit(17), F.lit(300))).otherwise(F.array(F.lit(0), F.lit(2), F.lit(5000))).cast("array<long>")
    got = {}
    for r in draw.first_rows(df, ["g"], "id", 42, wanted).collect():
        got.setdefault((r.g, r["__n"]), set()).add(r.id)
    for g in (0, 1, 2, 7):
        order = in_order([k for h, k in rows if h == g], 42)
        for n in (1, 17, 300) if g == 1 else (0, 2, 5000):
            assert got.get((g, n), set()) == set(order[:n])


def test_draw_without_keys_and_from_nothing(spark):
    df = spark.range(500).toDF("id")
    got = sorted(r.id for r in fidelity.pick(df, [], "id", 7, F.lit(20)).collect())
    assert got == sorted(in_order(range(500), 7)[:20])
    assert fidelity.pick(df.limit(0), [], "id", 7, F.lit(20)).count() == 0


def test_rows_that_are_not_drawn_stay_where_they_are(spark):
    """The last step is a filter beside a broadcast threshold: no window, and no exchange of rows."""
    df = spark.range(10_000).selectExpr("id", "id % 4 AS g", "repeat('x', 50) AS wide")
    plan = fidelity.pick(df, ["g"], "id", 1, F.lit(9))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_order_buckets_follow_the_order(spark):
    places = {r.id: r.place for r in fidelity.seeded_order(spark.range(700).toDF("id"), [], "id", 3, "place").collect()}
    assert [i for i, _ in sorted(places.items(), key=lambda x: x[1])] == in_order(range(700), 3)
