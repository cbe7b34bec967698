"""File checks, registries and pool files."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage

REGISTRY_SCHEMA = (
    "registry_version int, methods array<struct<method_id: string, method_family: string, source_model: string, source_directory: string, "
    "path: string, sha256: string, rows: bigint, logical_shape: array<bigint>, training_seed: int, space: string, window_length: int, "
    "n_channels: int, channel_order: array<string>, features_flat_length: int, normalization_status: string, contract_status: string, "
    "donor_lineage_status: string>>"
)


#: Bytes of a file that a task holds at a time.
PIECE = 8 << 20


def _open(path: str):
    """A stream over the file that Spark's listing calls ``path``."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream(unquote("/" + rest.lstrip("/")))
    # Spark's names of object stores, and those of the reader.
    system, at = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    return system.open_input_stream(at)


def _digest_batches(batches):
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            state = hashlib.sha256()
            with _open(path) as stream:
                while piece := stream.read(PIECE):
                    state.update(piece)
            found.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "sha256"])


def file_hashes(spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_task: int = 16) -> DataFrame:
    """(path, length, sha256) of the files under ``path``.

    Spark lists the files and deals them to tasks; a task reads one after the other in pieces of
    PIECE bytes, so a file may be of any size. A digest is sequential, so a file is one task's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    listed = stage(files.select("path", "length"), "file-list")
    tasks = max(1, listed.count() // files_per_task)
    return listed.repartition(tasks, "path").mapInArrow(_digest_batches, "path string, length long, sha256 string")


def verify_snapshot(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files of a snapshot against its manifest of (path, sha256)."""
    return compare_hashes(manifest, file_hashes(spark, path))


def compare_hashes(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Status of every path in either table of (path, sha256): ok, changed, missing or unlisted."""
    now = found.select("path", F.col("sha256").alias("found"))
    joined = manifest.select("path", F.col("sha256").alias("expected")).join(now, "path", "full_outer")
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("expected").isNull(), "unlisted")
        .when(F.col("found") == F.col("expected"), "ok")
        .otherwise("changed")
    )
    return joined.withColumn("status", status)


def write_registry(entries: DataFrame, path: str, version: int = 1) -> None:
    """One JSON document with the entries as a list. A registry has one entry per pool."""
    entry = F.struct(*entries.columns)
    doc = entries.agg(F.sort_array(F.collect_list(entry)).alias("methods")).select(F.lit(version).alias("registry_version"), "methods")
    doc.write.json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a registry document, one row each."""
    doc = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", "true").json(path)
    return doc.select("registry_version", F.explode("methods").alias("m")).select("registry_version", "m.*")


def read_pools(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pool files of several producers or seeds as one table with the file of each row.

    Older pools name their seed column ``seed``; both names are accepted.
    """
    pools = spark.read.option("mergeSchema", "true").parquet(*paths)
    names = [c for c in ("training_seed", "seed") if c in pools.columns]
    if not names:
        raise ValueError("pool files have neither training_seed nor seed")
    return pools.select(
        F.coalesce(*names).alias("training_seed"),
        *[c for c in pools.columns if c not in names],
        F.col("_metadata.file_path").alias("source_parquet"),
    )
