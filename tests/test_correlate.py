"""Masked block correlations against direct pairwise-complete ones."""

import numpy as np
import pytest

from tickloom.operators import correlate, explore

SCHEMA = "date date, ticker string, log_return double"


def panel(spark, x):
    import datetime

    day = datetime.date(2020, 1, 1)
    rows = [(day + datetime.timedelta(days=i), f"t{j:04d}", float(v)) for (i, j), v in np.ndenumerate(x) if not np.isnan(v)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def direct(x):
    out = {}
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if both.any():
                u, v = x[both, a], x[both, b]
                flat = u.std() < 1e-14 or v.std() < 1e-14
                out[f"t{a:04d}", f"t{b:04d}"] = (int(both.sum()), None if flat else float(np.corrcoef(u, v)[0, 1]))
    return out


def gappy(seed, days, tickers, gaps=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(days, 1)) * rng.normal(size=tickers) + rng.normal(size=(days, tickers)) + 1000
    x[rng.random(x.shape) < gaps] = np.nan
    return x


@pytest.mark.parametrize("block, chunk, per_task", [(256, 512, 16), (4, 8, 2)])
def test_pairwise_complete_correlations(spark, monkeypatch, block, chunk, per_task):
    monkeypatch.setattr(correlate, "CHUNKS_PER_TASK", per_task)
    x = gappy(1, 60, 11)
    x[:, 5] = np.where(np.isnan(x[:, 5]), np.nan, 2.0)  # never moves
    x[:30, 6], x[30:, 7] = np.nan, np.nan  # no joint date
    got = {(r.t1, r.t2): (r.n, r.corr) for r in correlate.pair_correlations(panel(spark, x), "log_return", block=block, chunk=chunk).collect()}
    wanted = direct(x)
    assert got.keys() == wanted.keys() and ("t0006", "t0007") not in got
    for pair, (n, c) in wanted.items():
        assert got[pair][0] == n
        assert (got[pair][1] is None) == (c is None) and (c is None or got[pair][1] == pytest.approx(c, abs=1e-9))


def test_extremes_come_from_each_pair_of_blocks(spark):
    x = gappy(2, 50, 20)
    pairs = {k: c for k, (_, c) in direct(x).items()}
    order = sorted(pairs, key=lambda k: pairs[k])
    few = correlate.pair_correlations(panel(spark, x), "log_return", extremes=5, block=4, chunk=16)
    assert few.count() < len(pairs)
    table = {(r.side, r.place): (r.t1, r.t2) for r in correlate.top_bottom(panel(spark, x), "log_return", 5).collect()}
    assert [table["top", k] for k in range(1, 6)] == order[::-1][:5] and [table["bottom", k] for k in range(1, 6)] == order[:5]


def test_two_thousand_tickers(spark):
    """More tickers than fit as columns or aggregates: all 1,999,000 pairs, without a pivot."""
    x = gappy(3, 12, 2000, gaps=0.1)
    found = correlate.pair_correlations(panel(spark, x), "log_return")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "pivot" not in plan.lower()
    row = found.selectExpr("count(*) AS n", "count(corr) AS known", "max(abs(corr)) AS top").first()
    assert row.n > 1_990_000 and row.top <= 1 + 1e-9
    u, v = x[:, 17], x[:, 1901]
    both = ~np.isnan(u) & ~np.isnan(v)
    got = found.where("t1 = 't0017' AND t2 = 't1901'").first()
    assert got.n == both.sum() and got["corr"] == pytest.approx(np.corrcoef(u[both], v[both])[0, 1])


def test_wide_reads_named_tickers(spark):
    x = gappy(4, 9, 6)
    rows = explore.wide(panel(spark, x), "log_return", ["t0004", "t0001", "none"]).orderBy("date").collect()
    assert len(rows) == 9
    for k, r in enumerate(rows):
        for name, col in (("t0004", 4), ("t0001", 1)):
            assert r[name] == (None if np.isnan(x[k, col]) else x[k, col])
        assert r["none"] is None
