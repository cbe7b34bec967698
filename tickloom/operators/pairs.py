"""Statistics over all pairs of rows of a group, in tiles that return sums and counts only.

Rows are hashed into blocks of about ``TILE_ROWS``; every pair of blocks of a group meets in one
task. The work is quadratic, as a statistic of all pairs is, and each row is copied once per block
of its group; memory per task does not grow, and no pair ever leaves its tile but the few around
a wanted rank. Order statistics are exact and take two passes: the pairs of a seeded sample of rows
give edges that lie close together around each rank, one pass counts the pairs between all edges
(and takes whatever sums are asked for), and a second one brings the values between the two edges
that hold the rank. Where these are too many to bring, or the sample was wrong and the rank lies
beyond its edges, the gap is cut at evenly spaced floating-point numbers and counted again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import broadcast_if_small, stage
from .neighbours import matrix

TILE_ROWS = 2048
#: Rows of a group's sample, edges around a wanted rank, and values around it that are brought.
SAMPLE_ROWS, EDGES, BROUGHT = 512, 2048, 200_000


def squared_distances(a: np.ndarray, b: np.ndarray, rows: int = 32) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances) of a few rows of ``a`` at a time, by direct differences."""
    for lo in range(0, len(a), rows):
        gap = a[lo : lo + rows, None, :] - b[None, :, :]
        yield lo, np.einsum("ijk,ijk->ij", gap, gap)


class Pairs:
    """The tiles of (key, row_id, vec, side) rows; ``side`` is a boolean that sums may need."""

    def __init__(self, rows: DataFrame, key: str, row_id: list[str], vec: str, side: str | None = None, tile_rows: int = TILE_ROWS):
        self.key, self.row_id, self.vec = key, row_id, vec
        sizes = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")), "pair-groups")
        self.sizes = {r[0]: r[1] for r in sizes.collect()}  # the groups are a short list of names
        # Hashes up to the cut are about twice as many as a sample needs.
        share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_ROWS) / F.col("__rows"))
        cut = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * F.lit(float(1 << 63)) - F.lit(float(1 << 62))) * 2).cast("long")
        grid = sizes.select(key, F.ceil(F.col("__rows") / tile_rows).cast("int").alias("__n"), cut.alias("__cut"))
        # One row per group; the size is looked at before it is broadcast.
        keep = [key, *row_id, vec, *([side] if side and side not in row_id else [])]
        self.dealt = stage(rows.select(*keep).join(broadcast_if_small(grid), key).withColumn("__block", F.pmod(F.xxhash64(*row_id), F.col("__n")).cast("int")), "pair-rows")
        other = self.dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        self.tiles = other.select(
            key,
            F.least("__block", "__other").alias("__p"),
            F.greatest("__block", "__other").alias("__q"),
            "__block",
            F.col(vec).alias("__vec"),
            (F.col(side) if side else F.lit(False)).alias("__side"),
        ).groupBy(key, "__p", "__q")

    def run(self, per_tile: Callable, schema: str) -> DataFrame:
        """``per_tile(key, chunks)`` gives rows; chunks are (squared distances, sides, sides) of pairs."""

        def tile(group_key: tuple, rows: pa.Table) -> pa.Table:
            key, p, q = (x.as_py() for x in group_key)
            block, vec = np.asarray(rows["__block"]), matrix(rows["__vec"])
            side = np.asarray(rows["__side"]).astype(bool)
            mine, yours = block == p, block == q

            def chunks():
                b_side = side[yours]
                for lo, d in squared_distances(vec[mine], vec[yours]):
                    a_side = side[mine][lo : lo + len(d)]
                    keep = np.ones(d.shape, bool) if p != q else np.arange(d.shape[1])[None, :] > np.arange(lo, lo + len(d))[:, None]
                    yield d[keep], np.broadcast_to(a_side[:, None], d.shape)[keep], np.broadcast_to(b_side[None, :], d.shape)[keep]

            return per_tile(key, chunks())

        return self.tiles.applyInArrow(tile, schema)

    def sample_edges(self, ranks: dict[str, list[float]], sizes: dict[str, int]) -> dict[str, np.ndarray]:
        """Edges around the wanted ranks of each group's pairs, from the pairs of its first rows by hash."""
        place = F.row_number().over(W.partitionBy(self.key).orderBy("__h"))
        some = self.dealt.withColumn("__h", F.xxhash64(*self.row_id)).where(F.col("__h") <= F.col("__cut")).withColumn("__k", place)
        few: dict[str, list] = {}
        for r in some.where(F.col("__k") <= SAMPLE_ROWS).select(self.key, F.col(self.vec).alias("v")).collect():  # SAMPLE_ROWS a group
            few.setdefault(r[0], []).append(r.v)
        out = {}
        for key, wanted in ranks.items():
            x = np.array(few.get(key, []), dtype=float).reshape(len(few.get(key, [])), -1)
            if len(x) < 2:
                out[key] = np.zeros(0)
                continue
            d = np.sort(np.concatenate([part[np.arange(len(x))[None, :] > np.arange(lo, lo + len(part))[:, None]] for lo, part in squared_distances(x, x)]))
            edges = []
            for rank in wanted:
                share = rank / max(1, sizes[key] - 1)
                reach = 6 * np.sqrt(share * (1 - share) / len(x)) + 2 / len(x)
                at = np.clip(np.linspace(share - reach, share + reach, EDGES) * (d.size - 1), 0, d.size - 1)
                edges.append(np.interp(at, np.arange(d.size), d))
            out[key] = np.unique(np.concatenate(edges))
        return out

    def count_between(self, edges: dict[str, np.ndarray], also: Callable | None = None, schema: str = "") -> tuple[dict[str, np.ndarray], DataFrame | None]:
        """Per group, how many pairs lie at or below the first edge, between two, and above the last.

        ``also(key, squared distances, sides, sides, sums)`` adds to a list of sums in the same
        pass, whose rows by tile come back as a table (key, sums).
        """

        def count(key, chunks):
            own, sums = edges.get(key, np.zeros(0)), []
            total = np.zeros(own.size + 1, np.int64)
            for d, a, b in chunks:
                total += np.bincount(np.searchsorted(own, d, "left"), minlength=total.size)
                if also is not None:
                    sums = also(key, d, a, b, sums)
            return pa.table({"key": pa.array([key], pa.string()), "counts": pa.array([total.tobytes()], pa.binary()), "sums": pa.array([sums], pa.list_(pa.float64()))})

        found = stage(self.run(count, "key string, counts binary, sums array<double>"), "pair-counts")

        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(c.as_py(), dtype=np.int64) for c in rows["counts"])
            return pa.table({"key": rows["key"][:1].combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})

        # First the tiles of a part, then the parts of a group: EDGES counts per rank each.
        parted = found.select("key", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("part"))
        parts = parted.groupBy("key", "part").applyInArrow(add, "key string, counts binary")
        totals = parts.groupBy("key").applyInArrow(add, "key string, counts binary").collect()
        return {r.key: np.frombuffer(r.counts, dtype=np.int64) for r in totals}, found.select("key", "sums")

    def order_statistics(self, ranks: dict[str, list[int]], edges: dict[str, np.ndarray], counts: dict[str, np.ndarray]) -> tuple[dict, dict]:
        """For each group, the intervals (low, high] of squared distances that hold its 0-based ranks, and
        the ranks inside them, narrowed until their pairs can be brought: (intervals, ranks inside)."""
        held: dict[str, list] = {}
        for key, wanted in ranks.items():
            upto = np.cumsum(counts[key])
            held[key] = []
            for rank in wanted:
                k = int(np.searchsorted(upto, rank, "right"))
                low = edges[key][k - 1] if k else -np.inf
                high = edges[key][k] if k < edges[key].size else np.inf
                held[key].append((low, high, rank - int(upto[k] - counts[key][k]), int(counts[key][k])))
        while any(n > BROUGHT and not _single(low, high) for gaps in held.values() for low, high, _, n in gaps):
            finer = {}
            for key, gaps in held.items():
                cuts = [_between(low, high) for low, high, _, n in gaps if n > BROUGHT]
                finer[key] = np.unique(np.concatenate([*cuts, *[[x for x in gap[:2] if np.isfinite(x)] for gap in gaps], np.zeros(0)]))
            again, _ = self.count_between(finer)
            for key, gaps in held.items():
                upto = np.cumsum(again[key])
                for j, (low, high, rank, n) in enumerate(gaps):
                    if n > BROUGHT:
                        before = int(upto[np.searchsorted(finer[key], low, "left")]) if np.isfinite(low) else 0
                        k = int(np.searchsorted(upto, before + rank, "right"))
                        gaps[j] = (
                            finer[key][k - 1] if k else -np.inf,
                            finer[key][k] if k < finer[key].size else np.inf,
                            before + rank - int(upto[k] - again[key][k]),
                            int(again[key][k]),
                        )
        return {k: [g[:2] for g in gaps] for k, gaps in held.items()}, {k: [g[2:] for g in gaps] for k, gaps in held.items()}

    def bring(self, intervals: dict[str, list], also: Callable | None = None) -> tuple[dict, DataFrame]:
        """The sorted squared distances inside each interval, BROUGHT of them at most unless they are
        equal, and the sums of ``also`` by tile, in one pass."""

        def inside(key, chunks):
            gaps, sums = intervals.get(key, []), []
            kept: list = [[] for _ in gaps]
            for d, a, b in chunks:
                for j, (low, high) in enumerate(gaps):
                    if not _single(low, high):
                        kept[j].append(d[(d > low) & (d <= high)])
                if also is not None:
                    sums = also(key, d, a, b, sums)
            flat = [np.concatenate([*x, np.zeros(0)]) for x in kept]
            return pa.table(
                {
                    "key": pa.array([key], pa.string()),
                    "sums": pa.array([sums], pa.list_(pa.float64())),
                    "kept": pa.array([[x.tobytes() for x in flat]], pa.list_(pa.binary())),
                }
            )

        found = stage(self.run(inside, "key string, sums array<double>, kept array<binary>"), "pair-values")
        values: dict[str, list] = {k: [[] for _ in gaps] for k, gaps in intervals.items()}
        long = found.select("key", F.posexplode("kept").alias("j", "x")).where(F.octet_length("x") > 0)
        for r in long.collect():  # BROUGHT numbers an interval at most
            values[r.key][r.j].append(np.frombuffer(r.x))
        return {k: [np.sort(np.concatenate([*x, np.zeros(0)])) for x in xs] for k, xs in values.items()}, found.select("key", "sums")


def _single(low: float, high: float) -> bool:
    """Whether (low, high] holds one number; squared distances aren't negative."""
    return high <= (0.0 if low < 0 else np.nextafter(low, np.inf))


def _between(low: float, high: float) -> np.ndarray:
    """Edges from low to high at even steps of the floating-point order; distances aren't negative."""
    bits = lambda x: int(np.array([x]).view(np.int64)[0])
    a, b = bits(max(low, 0.0)), bits(min(high, np.finfo(float).max))
    step = max(1, (b - a) // EDGES)
    return np.arange(a, b, step, dtype=np.int64).view(np.float64)


def _picked(values: dict, intervals: dict, inside: dict) -> dict[str, list[float]]:
    """The wanted values of each group; an interval of one number is that number."""
    out = {}
    for key, gaps in intervals.items():
        out[key] = [
            float(high) if _single(low, high) else float(x[rank])
            for (low, high), (rank, _), x in zip(gaps, inside[key], values[key])
        ]
    return out


def pairwise_distances(rows: DataFrame, key: str, row_id: str, vec: str = "features_flat", tile_rows: int = TILE_ROWS) -> DataFrame:
    """Summary of the distances of all i < j pairs of rows, per group."""
    pairs = Pairs(rows, key, [row_id], vec, tile_rows=tile_rows)
    probs = (0.01, 0.05, 0.5, 0.95)
    sizes = {k: n * (n - 1) // 2 for k, n in pairs.sizes.items() if n > 1}
    places = {k: [p * (n - 1) for p in probs] for k, n in sizes.items()}
    ranks = {k: [int(f(x)) for x in xs for f in (np.floor, np.ceil)] for k, xs in places.items()}
    edges = pairs.sample_edges({k: xs for k, xs in places.items()}, sizes)

    def moments(key, d, a, b, sums):
        if not d.size:
            return sums
        s, ss, low, high = sums or [0.0, 0.0, np.inf, -np.inf]
        return [s + float(np.sqrt(d).sum()), ss + float(d.sum()), min(low, float(d.min())), max(high, float(d.max()))]

    counts, sums = pairs.count_between(edges, moments)
    at = lambda j: F.get("sums", F.lit(j))
    total = sums.where(F.size("sums") > 0).groupBy("key").agg(F.sum(at(0)).alias("s"), F.sum(at(1)).alias("ss"), F.min(at(2)).alias("low"), F.max(at(3)).alias("high"))
    total = {r.key: r for r in total.collect()}  # one row per group
    intervals, inside = pairs.order_statistics(ranks, edges, {k: counts[k] for k in sizes})
    picked = _picked(pairs.bring(intervals)[0], intervals, inside)
    out = []
    for k, n in sizes.items():
        r = total[k]
        lo, hi = np.sqrt(picked[k][0::2]), np.sqrt(picked[k][1::2])
        q = [float(a + (b - a) * (x - np.floor(x))) for a, b, x in zip(lo, hi, places[k])]
        mean = r.s / n
        out.append((k, n, mean, q[2], float(np.sqrt(max(r.ss / n - mean * mean, 0.0))), float(np.sqrt(r.low)), q[0], q[1], q[3], float(np.sqrt(r.high))))
    schema = f"{key} string, n_pairs long, mean double, median double, std double, min double, p01 double, p05 double, p95 double, max double"
    return rows.sparkSession.createDataFrame(out, schema)


#: Terms of the series that moves kernel sums from the middle of the median's interval to the median.
_TERMS = 4


def mmd_rbf(rows: DataFrame, key: str, row_id: str, vec: str = "features_flat", tile_rows: int = TILE_ROWS) -> DataFrame:
    """Unbiased MMD^2 with an RBF kernel on all rows; gamma is one over the median squared distance.

    ``rows`` holds (key, is_real, row_id, vec). The median is taken over all ordered pairs of the
    joint rows, each with itself included. The pass that brings the values around the median also
    sums the kernels and their derivatives at a gamma from the middle of the interval; it is narrow,
    so a few terms of the series give the sums at the median's own gamma to rounding. Where it is
    not, the kernels take a pass of their own.
    """
    pairs = Pairs(rows, key, ["is_real", row_id], vec, "is_real", tile_rows)
    real = F.col("is_real").cast("long")
    sizes = {r.key: (r.n, r.m) for r in rows.groupBy(F.col(key).alias("key")).agg(F.sum(real).alias("n"), F.sum(1 - real).alias("m")).collect()}

    def pair_rank(place: int, n: int) -> int | None:
        """Where an ordered pair's rank lies among the i < j pairs; none among the n zeros of i = i."""
        return None if place < n else (place - n) // 2

    middle = {}
    for k, (n, m) in sizes.items():
        size = (n + m) ** 2
        middle[k] = [pair_rank((size - 1) // 2, n + m), pair_rank(size // 2, n + m)]
    ranks = {k: [r for r in rs if r is not None] for k, rs in middle.items()}
    n_pairs = {k: (n + m) * (n + m - 1) // 2 for k, (n, m) in sizes.items()}
    edges = pairs.sample_edges(ranks, n_pairs)
    counts, _ = pairs.count_between(edges)
    intervals, inside = pairs.order_statistics(ranks, edges, {k: counts.get(k, np.zeros(1, np.int64)) for k in ranks})

    def gamma_of(values: dict[str, list[float]]) -> dict[str, float]:
        out = {}
        for k, rs in middle.items():
            got = iter(values.get(k, []))
            out[k] = 1.0 / max(sum(0.0 if r is None else next(got) for r in rs) / 2.0, 1e-8)
        return out

    near = gamma_of({k: [min(high, np.finfo(float).max) if not np.isfinite(low) else low / 2 + min(high, 2 * low + 1) / 2 for low, high in gaps] for k, gaps in intervals.items()})

    def kernels(gamma: dict[str, float], terms: int):
        def add(key, d, a, b, sums):
            side, e = a.astype(int) + b, np.exp(-gamma[key] * d)
            parts = [np.bincount(side, weights=e * d**t, minlength=3) for t in range(terms)]
            return (np.concatenate(parts) + (np.array(sums) if sums else 0.0)).tolist()

        return add

    def added(sums: DataFrame, terms: int) -> dict[str, np.ndarray]:
        cells = [F.sum(F.get("sums", F.lit(j))).alias(f"c{j}") for j in range(3 * terms)]
        return {r[0]: np.array(r[1:], dtype=float).reshape(terms, 3) for r in sums.where(F.size("sums") > 0).groupBy("key").agg(*cells).collect()}

    values, sums = pairs.bring(intervals, kernels(near, _TERMS))
    gamma = gamma_of(_picked(values, intervals, inside))
    found = added(sums, _TERMS)
    out = []
    # The first term left out, against what the kernel adds: (gamma' - gamma)^4 d^4 / 24, d up to some 40 / gamma.
    close = {k: abs(gamma[k] / near[k] - 1) for k in gamma}
    wide = {k for k in gamma if (40 * close[k]) ** _TERMS > 1e-14}
    if wide:
        again = added(pairs.bring({}, kernels(gamma, 1))[1], 1)
    for k in sizes:
        n, m = sizes[k]
        if k in wide:
            yy, xy, xx = again[k][0]
        else:
            yy, xy, xx = sum(found[k][t] * (near[k] - gamma[k]) ** t / math.factorial(t) for t in range(_TERMS)) if k in found else np.zeros(3)
        out.append((k, n, m, gamma[k], float(2 * xx / (n * (n - 1)) + 2 * yy / (m * (m - 1)) - 2 * xy / (n * m))))
    return rows.sparkSession.createDataFrame(out, f"{key} string, n_real long, n_synthetic long, gamma double, mmd double")
