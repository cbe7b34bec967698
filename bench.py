"""Time the headline queries, each from the source files on, and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tickloom.plans import inputs, registry

HEADLINE = (
    "panel_ingest",
    "clean_panel",
    "daily_features",
    "sliding_windows",
    "channel_stats",
    "ar1_jitter",
    "regime_mixup",
    "wasserstein",
    "nn_summary",
    "return_acf",
    "contract_report",
    "downstream_summary",
    "scorecard_distances",
    "c2st",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_STAGE_DIR") or tempfile.mkdtemp(prefix="tickloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["wasserstein"](spark, "/root/testdata/sf0.001").collect()  # warm the JVM
    seconds = {}
    for name in HEADLINE:
        inputs.forget()
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    result = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
