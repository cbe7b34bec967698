"""Session helpers: shared checkpoint folder and written stages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local-mode session may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tickloom-")
    return _local_dirs[app]


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, keeps column pruning and filter pushdown for what follows,
    gives the optimizer the true size, and survives the loss of executors.
    """
    path = f"{shared_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and bound Arrow batches in bytes.

    Arrow and pandas workers import it by name, and a cluster's executors may lack it. Spark
    serves the archive to every executor, also to those that join later. A batch of long texts is
    then no larger than one of short ones, unless the application's own configuration names a bound.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(bound):
        spark.conf.set(bound, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tickloom-")) / "tickloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


BROADCAST_LIMIT = 64 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint only when the optimizer's size of ``df`` is under ``limit`` bytes.

    For a staged table that size is the size of its files. Above the limit the join is
    left to Spark, which shuffles both sides.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def small(df: DataFrame, name: str = "small") -> DataFrame:
    """``df`` as a stage, so that its true size decides whether a join broadcasts it.

    For tables of one row per group, which are joined to rows that one group may hold.
    """
    return broadcast_if_small(stage(df, name))
