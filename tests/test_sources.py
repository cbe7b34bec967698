"""Readers, writers and file checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.session import broadcast_if_small, shared_dir, stage
from tickloom.sources import files, panel

SCHEMA = "date date, ticker string, open double, high double, low double, close double, volume double"


@pytest.fixture()
def bars(spark):
    rows = [(dt.date(2000 + k % 3, 1, 1 + k), t, 1.0, 2.0, 0.5, 1.5, 1 / 3) for k in range(20) for t in ("A", "B")]
    return spark.createDataFrame(rows, SCHEMA)


def test_ticker_files_round_trip(spark, bars, tmp_path):
    panel.write_ticker_files(bars, str(tmp_path / "p"))
    back = panel.read_ticker_files(spark, str(tmp_path / "p"))
    assert sorted(back.collect()) == sorted(bars.select(*panel.PANEL_COLUMNS).collect())
    with pytest.raises(ValueError, match="volume"):
        bars.drop("volume").write.parquet(str(tmp_path / "q"))
        panel.read_ticker_files(spark, str(tmp_path / "q"))


def test_both_sinks_hold_the_rows(spark, bars, tmp_path):
    panel.write_tables(bars, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/parquet")).count() == 40
    text = spark.read.option("header", True).csv(str(tmp_path / "t/csv"))
    assert text.first().volume == "0.333333333333" and text.count() == 40


def test_dates_move_to_utc_midnight(spark):
    df = spark.sql("SELECT timestamp '2020-03-01 03:00:00' AS ts")
    assert df.select(panel.normalize_date(F.col("ts"), "Asia/Kolkata")).first()[0] == dt.date(2020, 2, 29)


def test_snapshot_check_sees_changes(spark, bars, tmp_path):
    path = str(tmp_path / "s")
    bars.repartition(2).write.parquet(path)
    manifest = files.file_hashes(spark, path).select("path", "sha256").collect()
    rows = [(manifest[0].path, manifest[0].sha256), (manifest[1].path, "0" * 64), ("file:/gone.parquet", "1" * 64)]
    listed = spark.createDataFrame(rows, "path string, sha256 string")
    assert sorted(r.status for r in files.verify_snapshot(spark, path, listed).collect()) == ["changed", "missing", "ok"]


def test_pools_accept_both_seed_names(spark, tmp_path):
    spark.range(3).withColumn("training_seed", F.lit(42)).write.parquet(str(tmp_path / "a"))
    spark.range(2).withColumn("seed", F.lit(7)).write.parquet(str(tmp_path / "b"))
    got = files.read_pools(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {r.training_seed: r["count"] for r in got.groupBy("training_seed").count().collect()} == {42: 3, 7: 2}
    assert got.select("source_parquet").distinct().count() >= 2


def test_stage_keeps_schema_and_rows(spark, bars):
    again = stage(bars, "bars")
    assert again.schema.fieldNames() == bars.schema.fieldNames() and again.count() == 40
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", shared_dir(spark)).rstrip("/")


def test_broadcast_hint_needs_a_small_table(spark, bars):
    staged = stage(bars, "bars")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(staged)) and not hinted(broadcast_if_small(staged, limit=1))


def test_a_file_beyond_two_gigabytes_is_hashed_in_pieces(spark, tmp_path):
    """A sparse file of 2.2 GB, which no single row could hold, beside a small one."""
    import hashlib

    size = 2_200_000_000
    with open(tmp_path / "large file.parquet", "wb") as out:
        out.truncate(size)
    (tmp_path / "small.parquet").write_bytes(b"abc")
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    state, piece = hashlib.sha256(), bytes(1 << 20)
    for at in range(0, size, len(piece)):
        state.update(piece[: size - at])
    assert sorted(got.values()) == sorted([(size, state.hexdigest()), (3, hashlib.sha256(b"abc").hexdigest())])


def test_stored_tables_join_without_an_exchange_and_skip_other_years(spark, bars):
    from tickloom.operators import splits
    from tickloom.sources import layout

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = layout.store(bars, "stored_bars", ["date", "ticker"], 4)
        right = layout.store(bars.select("date", "ticker", F.lit("x").alias("split")), "stored_labels", ["date", "ticker"], 4)
        joined = left.drop("year").join(right.drop("year"), ["date", "ticker"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 40
        one, report = splits.join_one_to_one(left.drop("year"), right.drop("year"), ["date", "ticker"])
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan  # the last sum alone is one row
        assert tuple(report.first()) == (40, 40, 0, 0, 0, 0, 40) and one.count() == 40
        year = layout.between(left, "2001-01-01", "2001-12-31")
        assert "PartitionFilters: [isnotnull(year" in year._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.date for r in year.collect()) == sorted(r.date for r in bars.where("year(date) = 2001").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS stored_bars")
        spark.sql("DROP TABLE IF EXISTS stored_labels")
