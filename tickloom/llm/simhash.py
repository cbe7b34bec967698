"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint is the bitwise majority of the XXH64 values of a text's 3-word shingles.
Two fingerprints are linked at three or fewer differing bits, and a class is a connected
component. Links are found over distinct fingerprints, so exact copies cost one row:

1. bits that vary together are put in the same of four parts (64 x 64 counts from all rows);
2. a table of how many fingerprints have each part value (at most parts x 2^16 counts, whatever
   the input) estimates how many candidates a probe at each threshold would meet;
3. each fingerprint gets its own unequal thresholds e_i - 1 with sum(e_i) = 4, by dynamic
   programming on these estimates. If a pair differed in e_i bits or more in every part, it
   would differ in 4 or more, so one part always finds it; a part with e_i = 0 isn't probed;
4. probes and index rows of a part value meet in one tile and are verified bit by bit. A value
   held by many is cut into tiles of both sides, so that no task needs them all, and a tile
   returns only a spanning forest of its links.

Edge cases: a null text counts as empty; texts without words have fingerprint zero and are
linked like any other; a text of one or two words is one shingle; every row of a repeated id is
returned; a null doc_id takes part in links but is never a class id (null if it is alone); texts of
any length are read whole; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage
from .common import components, query, table, texts

BITS = 64
MAX_BITS = 3
PARTS = 4
WIDTH = BITS // PARTS
SHINGLE = 3
SEED = 42
#: Rows of one side that a tile holds at most, in the mean.
TILE = 4096
#: Rows of probes and index entries in a task's group, in the mean.
GROUP_ROWS = 50_000
#: Cost of sending a probe, in compared pairs.
PROBE_COST = 2.0
_BLOCK = 1 << 17


def fingerprint(text: bytes) -> int:
    ws = text.lower().split()
    if not ws:
        return 0
    shingles = map(b" ".join, zip(*(ws[k:] for k in range(SHINGLE)))) if len(ws) >= SHINGLE else iter([b" ".join(ws)])
    n = max(1, len(ws) - SHINGLE + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, _BLOCK):
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=min(_BLOCK, n - start))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches):
    for batch in batches:
        found = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(2)], names=["doc_id", "fp", "text_hash"])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, the fingerprint's 64 bits as a long, and text_hash."""
    own = texts(docs).withColumn("text_hash", text_hash(F.col("text")))
    return own.mapInArrow(_fingerprint_batches, "doc_id long, fp long, text_hash long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pair_counts(batches):
    """How often bits i and j are both set, and are set at all, in this task's rows."""
    both, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        both += x.T @ x
        n += len(x)
    places = np.append(np.arange(BITS * BITS), -1)
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["place", "n"])


def correlated_parts(fps: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Bits in ``parts`` groups of one size, each grown by the bit nearest in correlation."""
    sums = fps.mapInArrow(_pair_counts, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    flat = {r.place: r.n for r in sums.collect()}  # 64 x 64 + 1 rows
    n = max(1, flat.pop(-1, 0))
    both = np.zeros(BITS * BITS)
    for place, count in flat.items():
        both[place] = count
    both = both.reshape(BITS, BITS) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    like = np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    free, groups = set(range(BITS)), []
    for _ in range(parts):
        left = sorted(free)
        group = [left[int(np.argmax(like[np.ix_(left, left)].sum(axis=1)))]]
        free.discard(group[0])
        while len(group) < BITS // parts:
            left = sorted(free)
            group.append(left[int(np.argmax(like[np.ix_(left, group)].mean(axis=1)))])
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def part_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(rows, parts): the bits of each group as a number."""
    bits = _bits(fps)
    return np.stack([bits[:, g].astype(np.int64) @ (1 << np.arange(len(g))) for g in groups], axis=1)


def _within(counts: np.ndarray, most: int) -> np.ndarray:
    """(most + 1, 2^w): how many rows have a value within 0, 1, ... ``most`` bits of each value."""
    width, at = int(np.log2(counts.size)), np.arange(counts.size)
    around = lambda c: sum(c[at ^ (1 << b)] for b in range(width))
    shells = [counts, around(counts)]
    for d in range(2, most + 1):
        shells.append((around(shells[-1]) - (width - d + 2) * shells[-2]) // d)
    return np.cumsum(shells[: most + 1], axis=0)


def _masks(width: int, most: int) -> list[np.ndarray]:
    every = np.arange(1 << width)
    weight = np.bitwise_count(every)
    return [every[weight <= d] for d in range(most + 1)]


def allocate(values: np.ndarray, within: list[np.ndarray], masks: list[np.ndarray]) -> np.ndarray:
    """(rows, parts): the e_i of each row with the least estimated cost, their sum MAX_BITS + 1."""
    rows, parts = values.shape
    total = MAX_BITS + 1
    best = np.full((total + 1, rows), np.inf)
    best[0] = 0
    chosen = np.zeros((parts, total + 1, rows), dtype=np.int8)
    for i in range(parts):
        cost = [np.zeros(rows)] + [within[i][e - 1][values[:, i]] + PROBE_COST * len(masks[e - 1]) for e in range(1, total + 1)]
        now = np.full_like(best, np.inf)
        for s in range(total + 1):
            for e in range(s + 1):
                with_e = best[s - e] + cost[e]
                better = with_e < now[s]
                now[s][better] = with_e[better]
                chosen[i, s][better] = e
        best = now
    out, left = np.zeros((rows, parts), dtype=np.int8), np.full(rows, total)
    for i in range(parts - 1, -1, -1):
        out[:, i] = chosen[i, left, np.arange(rows)]
        left = left - out[:, i]
    return out


def _probes(values: np.ndarray, shares: np.ndarray, masks: list[np.ndarray]):
    """(row numbers, keys) of every probe, part by part and threshold by threshold."""
    for i in range(values.shape[1]):
        for e in range(1, MAX_BITS + 2):
            rows = np.flatnonzero(shares[:, i] == e)
            if rows.size:
                at = masks[e - 1]
                yield np.repeat(rows, at.size), (i << WIDTH) | (values[rows, i][:, None] ^ at[None, :]).ravel()


def _tally(names: list[str], counted: np.ndarray):
    keys = np.flatnonzero(counted)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counted[keys].astype(np.int64))], names=names)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 63-bit mix of longs, the same in every process."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def _read(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for start in range(0, fps.size, 20_000):
            yield fps[start : start + 20_000]


def _keyed(summed: DataFrame, size: int) -> np.ndarray:
    """Counts by key, of a table that has at most PARTS x 2^WIDTH rows."""
    out = np.zeros(size, dtype=np.int64)
    got = summed.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out


def links(fps: DataFrame) -> DataFrame:
    """(u, v): for distinct fingerprints ``fps`` (one column, staged), edges that have the same
    connected components as all pairs at MAX_BITS or fewer differing bits."""
    spark = fps.sparkSession
    groups = correlated_parts(fps)
    size = PARTS << WIDTH
    masks = _masks(WIDTH, MAX_BITS)
    offsets = np.arange(PARTS) << WIDTH

    def held(batches):
        counted = np.zeros(size, dtype=np.int64)
        for x in _read(batches):
            counted += np.bincount((part_values(x, groups) + offsets).ravel(), minlength=size)
        yield _tally(["key", "n"], counted)

    index = _keyed(fps.mapInArrow(held, "key long, n long"), size)
    shared_index = spark.sparkContext.broadcast(index)

    def estimates():
        return [_within(part, MAX_BITS) for part in shared_index.value.reshape(PARTS, -1)]

    def probed(batches):
        within, counted = estimates(), np.zeros(size, dtype=np.int64)
        for x in _read(batches):
            values = part_values(x, groups)
            for _, keys in _probes(values, allocate(values, within, masks), masks):
                counted += np.bincount(keys, minlength=size)
        yield _tally(["key", "n"], counted)

    asked = _keyed(fps.mapInArrow(probed, "key long, n long"), size)
    tiles = np.stack([-(-index // TILE), -(-asked // TILE)])
    n_rows = int((index * tiles[1] + asked * tiles[0])[(index > 0) & (asked > 0)].sum())
    n_bins = max(1, n_rows // GROUP_ROWS)
    shared_tiles = spark.sparkContext.broadcast(tiles.astype(np.int32))

    def dealt(keys, x, side):
        """Rows of one side: each goes to one tile of its own side, with every tile of the other."""
        own, other = shared_tiles.value[side][keys], shared_tiles.value[1 - side][keys]
        use = (own > 0) & (other > 0)
        keys, x, own, other = keys[use], x[use], own[use], other[use]
        mine = _mix(x) % np.maximum(own, 1)
        again = np.repeat(np.arange(keys.size), other)
        theirs = np.arange(again.size) - np.repeat(np.cumsum(other) - other, other)
        pair = (mine[again], theirs) if side == 0 else (theirs, mine[again])
        slot = (keys[again].astype(np.int64) << 40) | (pair[0] << 20) | pair[1]
        return pa.RecordBatch.from_arrays(
            [pa.array((_mix(slot) % n_bins).astype(np.int32)), pa.array(slot), pa.array(x[again]), pa.array(np.full(again.size, side == 1))],
            names=["bin", "slot", "fp", "asks"],
        )

    def spread(batches):
        within = estimates()
        for x in _read(batches):
            values = part_values(x, groups)
            yield dealt((values + offsets).ravel(), np.repeat(x, PARTS), 0)
            for rows, keys in _probes(values, allocate(values, within, masks), masks):
                yield dealt(keys, x[rows], 1)

    rows = fps.mapInArrow(spread, "bin int, slot long, fp long, asks boolean")
    return rows.groupBy("bin").applyInArrow(_verify, "u long, v long")


_PAIRS = 1 << 21


def _verify(rows: pa.Table) -> pa.Table:
    """Compare the probes of a group with the index rows of their slots; a spanning forest."""
    slot, fp, asks = (rows.column(c).to_numpy() for c in ("slot", "fp", "asks"))
    nodes, node = np.unique(fp, return_inverse=True)
    order = np.argsort(slot[~asks], kind="stable")
    held_slot, held = slot[~asks][order], node[~asks][order]
    ask_slot, ask = slot[asks], node[asks]
    low = np.searchsorted(held_slot, ask_slot, "left")
    many = np.searchsorted(held_slot, ask_slot, "right") - low
    roots = np.arange(nodes.size)
    ends = np.cumsum(many)
    start = 0
    while start < ask.size:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _PAIRS, "right")))
        k = many[start:stop]
        u = np.repeat(ask[start:stop], k)
        place = np.arange(u.size) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[start:stop], k)
        v = held[place]
        apart = roots[u] != roots[v]
        u, v = u[apart], v[apart]
        near = np.bitwise_count((nodes[u] ^ nodes[v]).view(np.uint64)) <= MAX_BITS
        roots = union(roots, u[near], v[near])
        start = stop
    child = np.flatnonzero(roots != np.arange(nodes.size))
    return pa.table({"u": nodes[child], "v": nodes[roots[child]]})


def union(roots: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots after joining u[k] with v[k]; the smallest node of a class is its root."""
    while True:
        a, b = roots[u], roots[v]
        apart = a != b
        if not apart.any():
            return roots
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        roots = roots.copy()
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := roots[roots], roots):
            roots = up


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash, component_id and the class's root: one row per row of ``docs``."""
    own = stage(fingerprints(docs), "fingerprints")
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left")
    joined = stage(joined.select("fp", "first_doc", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = joined.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = stage(joined.join(smallest, "root").select("fp", "component_id", "root"), "classes")
    return own.join(classes, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: one row per row of ``docs``."""
    return _classified(docs).select("doc_id", "fp", "component_id")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the smallest id, then the smallest fingerprint, text hash and row
    hash. Rows that share an id but not a class are kept each. Rows without an id stay: no class
    can name them."""
    named = _classified(docs).where("doc_id = component_id")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "text_hash")).alias("first"))
    keep = first.select("first.doc_id", F.col("first.text_hash").alias("__text")).distinct()
    rows = docs.withColumn("__text", text_hash(F.col("text")))
    found = rows.join(keep, [rows["doc_id"] == keep["doc_id"], rows["__text"] == keep["__text"]], "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    found = found.groupBy("doc_id", "__text").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__row"))
    return found.select("__row.*").unionByName(docs.where("doc_id IS NULL"))


@query("op10_simhash_pigeonhole")
def op10_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
