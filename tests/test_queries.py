"""A few registered queries end to end against their SQL twins, and the plan of a scan."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_module
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 3


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["split_report", "window_counts", "channel_stats", "wasserstein", "registry_diff", "contract_report"])
def test_query_matches_sql(spark, con, name):
    good, note = check.compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql()[name], SF)
    assert good, note


def test_short_pools_stop_the_utility_queries(spark):
    with pytest.raises(ValueError, match="too few valid windows"):
        entry_module.queries()["downstream_raw"](spark, SF)


def test_scan_pushes_filters_and_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = entry_module.queries()["pushdown_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_quantity,30.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "l_extendedprice" not in plan


def test_a_candidate_with_a_short_pool_stops_the_strict_table(spark):
    from tickloom.plans import inputs, q_utility

    i = inputs.inputs_for(spark, SF)
    with pytest.raises(ValueError, match="too few valid windows"):
        q_utility.candidate_best(i, q_utility.sweep_pool(i))


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tickloom.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
