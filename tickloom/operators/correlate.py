"""Pairwise-complete correlations of any number of tickers, by products of masked blocks.

Tickers are put in order and cut into blocks, dates into chunks. A chunk of a block is a dense
matrix of values (zero where absent) beside its mask of presence, and products of two such
chunks give, for every pair of their tickers at once, the count of joint dates and the sums,
squares and products over them. Each pair of blocks meets in tasks that add up some chunks,
so no column is made per ticker, no aggregate per pair, and no date is a join key.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import small, stage
from .sequence import with_range_position

#: Tickers of a block, dates of a chunk, and chunks that one task adds up.
BLOCK, CHUNK, CHUNKS_PER_TASK = 256, 512, 16


def tickers_in_order(rows: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """(ticker, mean, block, slot): one row per ticker, in order of name."""
    each = rows.where(F.col(value).isNotNull()).groupBy("ticker").agg(F.avg(value).alias("mean"))
    placed = with_range_position(each, ["ticker"], "__at")
    return placed.select("ticker", "mean", F.floor(F.col("__at") / block).cast("int").alias("block"), (F.col("__at") % block).cast("int").alias("slot"))


def wide_blocks(rows: DataFrame, value: str, tickers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(date, block, values): the values of a block's tickers at their slots, null where absent."""
    own = rows.join(small(tickers, "tickers"), "ticker").where(F.col(value).isNotNull())
    cells = own.groupBy("date", "block", "slot").agg(F.max(value).alias("v"))
    held = cells.groupBy("date", "block").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("held"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: F.try_element_at("held", k))
    return held.select("date", "block", slots.alias("values"))


def _dense(rows: DataFrame, value: str, tickers: DataFrame, block: int, chunk: int) -> DataFrame:
    """(chunk, block, values, mask): dense chunks as bytes, values less their ticker's mean."""
    dates = with_range_position(rows.select("date").distinct(), ["date"], "__at")
    dates = dates.select("date", F.floor(F.col("__at") / chunk).cast("int").alias("chunk"), (F.col("__at") % chunk).cast("int").alias("row"))
    own = rows.where(F.col(value).isNotNull()).join(small(tickers, "tickers"), "ticker").join(small(dates, "dates"), "date")
    cells = own.groupBy("chunk", "block", "row", "slot").agg((F.max(value) - F.max("mean")).alias("v"))

    def fill(part: pa.Table) -> pa.Table:
        values, mask = np.zeros((chunk, block)), np.zeros((chunk, block), dtype=np.uint8)
        at = part["row"].to_numpy(), part["slot"].to_numpy()
        values[at], mask[at] = part["v"].to_numpy(), 1
        return pa.table(
            {
                "chunk": part["chunk"][:1].combine_chunks(),
                "block": part["block"][:1].combine_chunks(),
                "values": pa.array([values.tobytes()], pa.binary()),
                "mask": pa.array([np.packbits(mask).tobytes()], pa.binary()),
            }
        )

    return cells.groupBy("chunk", "block").applyInArrow(fill, "chunk int, block int, values binary, mask binary")


def _joint(x: np.ndarray, m: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """(6, block, block): n, and sums of x, y, xx, yy and xy over the dates that both have."""
    return np.stack([m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y])


def _pairs(sums: np.ndarray, p: int, q: int, extremes: int | None) -> tuple:
    """(slot of p, slot of q, n, corr) of each pair once, or of the highest and lowest ones alone."""
    n, x, y, xx, yy, xy = sums
    there = n > 0
    if p == q:
        there &= np.triu(np.ones_like(there), 1)
    a, b = np.nonzero(there)
    n, x, y, xx, yy, xy = (s[a, b] for s in sums)
    spread = (xx - x * x / n) * (yy - y * y / n)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.where(spread > 0, (xy - x * y / n) / np.sqrt(spread), np.nan)
    if extremes is not None:
        known = np.flatnonzero(~np.isnan(corr))
        order = known[np.lexsort((b[known], a[known], corr[known]))]
        keep = np.unique(np.concatenate([order[:extremes], order[-extremes:]]))
        a, b, n, corr = a[keep], b[keep], n[keep], corr[keep]
    return a, b, n.astype(np.int64), corr


def pair_correlations(returns: DataFrame, value: str, extremes: int | None = None, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(t1, t2, corr, n) of all pairs of tickers with joint dates, t1 before t2 in order of name.

    With ``extremes``, only that many highest and lowest pairs of each pair of blocks, among which
    the highest and lowest of all are.
    """
    tickers = stage(tickers_in_order(returns, value, block), "tickers")
    dense = stage(_dense(returns, value, tickers, block, chunk), "dense-blocks")
    n_blocks = (tickers.agg(F.max("block")).first()[0] or 0) + 1
    part = F.floor(F.col("chunk") / CHUNKS_PER_TASK).cast("int").alias("part")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    met = dense.select("*", part, other).select("chunk", "block", "values", "mask", "part", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def read(table: pa.Table) -> Iterable:
        """Per chunk that both blocks have: values and masks of the two."""
        held: dict = {}
        for c, b, v, m in zip(*(table[n].to_pylist() for n in ("chunk", "block", "values", "mask"))):
            mask = np.unpackbits(np.frombuffer(m, dtype=np.uint8)).reshape(chunk, block).astype(float)
            held.setdefault(c, {})[b] = (np.frombuffer(v).reshape(chunk, block), mask)
        return held.values()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        total = np.zeros((6, block, block))
        for blocks in read(table):
            if p in blocks and q in blocks:
                total += _joint(*blocks[p], *blocks[q])
        return pa.table({"p": pa.array([p], pa.int32()), "q": pa.array([q], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        p, q = (k.as_py() for k in key)
        total = sum(np.frombuffer(s.as_py()).reshape(6, block, block) for s in table["sums"])
        a, b, n, corr = _pairs(total, p, q, extremes)
        same = lambda x: pa.array(np.full(a.size, x, dtype=np.int32))
        return pa.table({"p": same(p), "a": a.astype(np.int32), "q": same(q), "b": b.astype(np.int32), "corr": pa.array(corr, from_pandas=True), "n": n})

    sums = met.groupBy("part", "p", "q").applyInArrow(add, "p int, q int, sums binary")
    found = sums.groupBy("p", "q").applyInArrow(finish, "p int, a int, q int, b int, corr double, n long")
    names = small(tickers.select("ticker", "block", "slot"), "ticker-names")
    first = names.select(F.col("ticker").alias("t1"), F.col("block").alias("p"), F.col("slot").alias("a"))
    second = names.select(F.col("ticker").alias("t2"), F.col("block").alias("q"), F.col("slot").alias("b"))
    return found.join(first, ["p", "a"]).join(second, ["q", "b"]).select("t1", "t2", "corr", "n")


def top_bottom(returns: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` most and least correlated pairs, from those of each pair of blocks."""
    pairs = stage(pair_correlations(returns, value, extremes=n), "extreme-pairs")
    parts = []
    for side, order in (("top", F.col("corr").desc()), ("bottom", F.col("corr").asc())):
        few = pairs.orderBy(order, "t1", "t2").limit(n).withColumn("side", F.lit(side))
        parts.append(few.withColumn("place", F.row_number().over(W.partitionBy("side").orderBy(order, "t1", "t2"))))
    return parts[0].unionByName(parts[1])
