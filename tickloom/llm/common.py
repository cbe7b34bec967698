"""What the text operators share: tables, words, registration, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small, ship_package, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` and ``bytes.lower()`` use the same six bytes and A-Z only.
GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, oracle: str | None = None):
    """Register a query, with its SQL twin where SQL can express it."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def text_runs(batch: pa.RecordBatch, column: int, most: int):
    """(first row, texts) of runs of a batch's rows that end where ``most`` bytes of text are reached."""
    text = batch.column(column)
    sizes = np.cumsum(pc.binary_length(text).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(text):
        before = sizes[first - 1] if first else 0
        stop = min(len(text), int(np.searchsorted(sizes, before + most)) + 1)
        yield first, text.slice(first, stop - first)
        first = stop


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (u, v of one type): (node, root), root the smallest node.

    Alternating large and small stars on DataFrames: each round is two aggregations and two
    joins, each writes a stage, and rounds end when the edge set stays the same. A hub's edges
    are joined, never gathered, so no task needs a whole component. Nodes without an edge are
    not in the result; null ends and loops are ignored.
    """
    links = edges.where("u != v")
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = _signature(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(rest.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        now = _signature(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


_held: dict = {}


def give_back() -> None:
    """Freed memory goes to the system, which allocators else keep for a worker that lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def worker_table(name, make: Callable):
    """A table that one operator's tasks share in a worker process, which runs one after the other.

    There is one at a time: another operator's tasks begin with their own and let this one go, so
    that the tables of a pipeline's stages never stand side by side.
    """
    if name not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[name] = make()
    return _held[name]


#: Rows of one key that a shuffled join may send to one task.
HOT_ROWS = 20_000


def join_counted(rows: DataFrame, by_key: DataFrame, key: list[str], count: str, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """``rows`` joined with ``by_key``, a staged table of one row a key whose column ``count`` says
    how many of ``rows`` have that key; ``count`` is not in the result.

    Keys of more than ``hot_rows`` rows, of which there are at most count(rows) / hot_rows, are
    joined where their rows are, by a broadcast whose size is checked; all others are shuffled.
    ``how`` is inner or left; null keys match nothing. ``rows`` is read twice if a key is hot.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    hot = stage(by_key.where(F.col(count) > hot_rows), "hot-keys")
    names = [c for c in by_key.columns if c not in (*key, count)]
    rest = by_key.where(F.col(count) <= hot_rows).select(*key, *names)
    named = F.lit(True)
    for k in key:
        named = named & F.col(k).isNotNull()
    if how == "left":
        nulls = by_key.schema
        unnamed = rows.where(~named).select(*rows.columns, *[F.lit(None).cast(nulls[c].dataType).alias(c) for c in names])
    columns = [*rows.columns, *names]
    if hot.isEmpty():
        out = rows.where(named).join(rest, key, how).select(*columns)
    else:
        there = broadcast_if_small(hot.select(*key, *names))
        cold = rows.where(named).join(broadcast_if_small(hot.select(*key)), key, "left_anti")
        out = rows.join(there, key).select(*columns).unionByName(cold.join(rest, key, how).select(*columns))
    return out.unionByName(unnamed) if how == "left" else out
