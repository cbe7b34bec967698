"""Ordered operators against pandas, on keys where one holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import sequence


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 4000
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n))
    frame = pd.DataFrame({"k": keys, "o": rng.permutation(n).astype("int64"), "v": np.round(rng.normal(size=n), 2)})
    return frame, spark.createDataFrame(frame).repartition(5)


def test_position_matches_sorted_rank(skewed):
    frame, df = skewed
    got = sequence.with_position(df, ["k"], [F.col("o")], [F.floor(F.col("o") / 100)]).toPandas()
    want = frame.assign(pos=frame.sort_values("o").groupby("k").cumcount())
    merged = got.merge(want, on=["k", "o"])
    assert len(merged) == len(frame)
    assert (merged.pos_x == merged.pos_y).all()


def test_position_without_keys(skewed):
    frame, df = skewed
    got = sequence.with_position(df, [], [F.col("o")], [F.floor(F.col("o") / 64)]).toPandas()
    assert (got.pos == got.o).all() and len(got) == len(frame)


def test_previous_crosses_buckets(skewed):
    frame, df = skewed
    got = sequence.with_previous(df, ["k"], "o", [F.floor(F.col("o") / 50)], "v", "prev").toPandas()
    want = frame.sort_values("o").assign(prev=lambda d: d.groupby("k").v.shift(1))
    merged = got.merge(want, on=["k", "o"])
    assert np.allclose(merged.prev_x, merged.prev_y, equal_nan=True)


def test_quantiles_are_exact(skewed):
    frame, df = skewed
    probs = {"p01": 0.01, "mid": 0.5, "p95": 0.95}
    got = sequence.quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    want = frame.groupby("k").v.quantile(list(probs.values())).unstack()
    for (name, p) in probs.items():
        assert np.allclose(got[name].sort_index(), want[p].sort_index())


def test_quantiles_without_keys_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "v double")
    row = sequence.quantiles(df, [], "v", {"m": 0.5, "hi": 1.0}).first()
    assert row.m == 3.0 and row.hi == 10.0


def test_sorted_runs_carry_totals(skewed):
    frame, df = skewed
    runs = sequence.sorted_runs(df, ["k"], "v", {"n": F.lit(1)}).toPandas().sort_values(["k", "x"])
    for key, part in runs.groupby("k"):
        mine = frame[frame.k == key].v
        assert part.cum_n.iloc[-1] == len(mine) == part.total_n.iloc[0]
        assert (part.cum_n.to_numpy() == part.n.cumsum().to_numpy()).all()
        assert np.allclose(part.next_x.iloc[:-1], part.x.iloc[1:]) and pd.isna(part.next_x.iloc[-1])
