"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct 2-word shingles. Two documents are linked if their sets overlap in
80 % of their union, and a class is a connected component. Equal sets are one set from the start.

1. A set gets POSITIONS minwise tokens: two sets agree at a position with a probability equal to
   their similarity. Bits of the tokens are its sketch.
2. A tree of nodes: in a node, all sets follow the same selected positions, 1 / THRESHOLD of them
   in the mean, chosen by a hash of the node; the token found there names the child. Similar sets
   walk together in the mean for ever, others part at once. A set's way to START levels needs
   nothing but its own tokens; from there on only sets in nodes of more than SMALL sets branch again.
3. Nodes of up to SMALL sets compare all sketches, and give a spanning forest of the close pairs.
   What still shares a larger node at the last level, which follows the number of sets, is put
   together without comparing. The number of independent trees follows from RECALL, the branching
   and the levels.
4. The connected components of these pairs are clusters, and each is searched exactly on the
   full sets: a pivot is compared with every set of the cluster, until all sets outside the
   cluster's largest class have been pivots. Two sets that were never compared are then both in
   that class, so a group of copies costs a few pivots, not its pairs. A cluster too large for
   a task is dealt to tiles, and its pivots, eight times as many each round, go to every tile.

Larger nodes and clusters are never one task: rows of larger nodes branch where they are.

Edge cases: a null text counts as empty; a text without words has no shingle, class itself, and is
linked with nothing; one word is one shingle; texts of any length are read whole; every row of a
repeated id is returned, and its texts may be in different classes; a null doc_id takes part in
links but is never a class id (null, and not kept, if it is alone); other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import broadcast_if_small, stage
from .common import components, join_counted, query, table, texts
from .simhash import text_hash, union

#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 80
THRESHOLD = PERCENT / 100
POSITIONS = 128
#: Target share of the pairs at the threshold that meet in some tree's leaf, at the deepest.
RECALL = 0.9995
#: Levels before the first comparison, and levels beyond for each factor of SPLIT that the sets are more than a node may be.
START, SPLIT = 2, 32
#: Sets of a node that are compared with each other.
SMALL = 256
#: Sketch bits of 128 that a pair at the threshold has different: 12.8 in the mean, 3.4 deviation.
MAX_BITS = 28
#: Rows of a comparing task, in the mean.
GROUP_ROWS = 50_000
#: Shingles of a cluster, or of a tile of one, that a task holds.
TILE_SHINGLES = 2_000_000
#: Pivots of a large cluster in the first round; each later one takes eight times as many.
PIVOTS = 8
_CHUNK = 1 << 18


def survival(depth: int) -> float:
    """The chance that a pair at the threshold is together in some node of a level: one selected
    position, and a second one with the chance that makes 1 / THRESHOLD of them."""
    second, alive = 1 / THRESHOLD - 1, 1.0
    for _ in range(depth):
        apart = 1 - THRESHOLD * alive
        alive = 1 - (1 - second) * apart - second * apart * apart
    return alive


def last_level(n_sets: int) -> int:
    """The level at which chance alone leaves no large node: two unlike sets agree at one position in SPLIT at most."""
    return START + max(2, math.ceil(math.log(max(1.0, n_sets / SMALL)) / math.log(SPLIT)))


def trees_for(levels: int) -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - survival(levels)))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- sets --------------------------------------------------------------------------------------


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the text's distinct 2-word shingles, in order."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))
    if h.size == 1:
        return mix(h, 1)
    return np.unique(mix((h[:-1] << np.uint64(1)) ^ (h[:-1] >> np.uint64(63)) ^ mix(h[1:], 2), 3))


_FACTORS = mix(np.arange(POSITIONS, dtype=np.uint64), 4) | np.uint64(1)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, POSITIONS): the least 32-bit hash of each set's shingles by each function; sets aren't empty."""
    out = np.empty((len(sets), POSITIONS), dtype=np.uint32)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (last == first or n + sets[last].size <= _CHUNK):
            n += sets[last].size
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *(s.size for s in sets[first : last - 1])])
        for k in range(POSITIONS):
            out[first:last, k] = np.minimum.reduceat(((flat * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32), starts)
        first = last
    return out


_SIGNED = "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, tokens binary, s1 long, s2 long"


def _sign(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [shingles(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
            some = np.array([k for k, s in enumerate(sets) if s.size], dtype=np.int64)
            tokens = np.zeros((len(sets), POSITIONS), dtype="<u4")
            if some.size:
                tokens[some] = minwise([sets[k] for k in some])
            keys = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
            sketch = np.packbits((tokens & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")
            flat = pa.array([row.tobytes() for row in tokens], pa.binary())
            columns = [part.column(0), part.column(2), pa.array(np.array([s.size for s in sets], dtype=np.int64)), *map(pa.array, keys.T), flat, *map(pa.array, sketch.T)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SIGNED.split(", ")])


# --- trees -------------------------------------------------------------------------------------


def branch(node: np.ndarray, row: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of (node, row of ``tokens``), and the row of each."""
    first = (mix(node, 5) % np.uint64(POSITIONS)).astype(np.int64)
    other = (first + 1 + (mix(node, 6) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
    again = mix(node, 7) / 2.0**64 < 1 / THRESHOLD - 1
    node, row, at = np.concatenate([node, node[again]]), np.concatenate([row, row[again]]), np.concatenate([first, other[again]])
    step = (at.astype(np.uint64) << np.uint64(32)) | tokens[row, at].astype(np.uint64)
    return mix(mix(node, 8) ^ mix(step, 9), 10), row


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, POSITIONS)


def _node_rows(node, row, batch):
    d, s1, s2 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[row] for c in ("d", "s1", "s2"))
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(d), pa.array(s1), pa.array(s2)], names=["node", "d", "s1", "s2"])


_NODE = "node long, d long, s1 long, s2 long"


def _starter(trees: int):
    def start(batches):
        roots = mix(np.arange(trees, dtype=np.uint64), 11)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                tokens = _tokens(batch.column(batch.schema.get_field_index("tokens")))
                node, row = np.repeat(roots, batch.num_rows), np.tile(np.arange(batch.num_rows), trees)
                for _ in range(START):
                    node, row = branch(node, row, tokens)
                yield _node_rows(node, row, batch)

    return start


def _go_on(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            nodes = batch.column(batch.schema.get_field_index("nodes"))
            lengths = np.diff(nodes.offsets.to_numpy())
            tokens = _tokens(batch.column(batch.schema.get_field_index("tokens")))
            flat = nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield _node_rows(*branch(flat, np.repeat(np.arange(batch.num_rows), lengths), tokens), batch)


_PAIRS = 1 << 21


def _compare(rows: pa.Table) -> pa.Table:
    """(u, v): of whole nodes, a spanning forest of the close pairs."""
    node, d, s1, s2 = (rows.column(c).to_numpy() for c in ("node", "d", "s1", "s2"))
    order = np.lexsort((d, node))
    node, d, s1, s2 = node[order], d[order], s1[order], s2[order]
    edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(edge, node.size))
    names, own = np.unique(d, return_inverse=True)
    roots = np.arange(names.size)
    left = np.repeat(edge + size, size) - np.arange(node.size) - 1
    ends, at = np.cumsum(left), 0
    while at < node.size:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + _PAIRS, "right")))
        k = left[at:stop]
        a = np.repeat(np.arange(at, stop), k)
        b = a + 1 + np.arange(a.size) - np.repeat(np.cumsum(k) - k, k)
        apart = roots[own[a]] != roots[own[b]]
        a, b = a[apart], b[apart]
        bits = np.bitwise_count((s1[a] ^ s1[b]).view(np.uint64)) + np.bitwise_count((s2[a] ^ s2[b]).view(np.uint64))
        roots = union(roots, own[a[bits <= MAX_BITS]], own[b[bits <= MAX_BITS]])
        at = stop
    child = np.flatnonzero(roots != np.arange(names.size))
    return pa.table({"u": names[child], "v": names[roots[child]]})


def close_pairs(sets: DataFrame) -> DataFrame:
    """(u, v): pairs of d that some node found close, enough of them to connect all that any found."""
    last = last_level(sets.count())
    rows = stage(sets.select("d", "s1", "s2", "tokens").mapInArrow(_starter(trees_for(last)), _NODE), "path-nodes")
    edges = None
    for level in range(START, last + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"))
        # One row per larger node: at most rows / SMALL of them, and their true size is looked at.
        large = broadcast_if_small(stage(sizes.where(F.col("n") > SMALL).drop("n"), "large-nodes"))
        small = rows.join(large.select("node"), "node", "left_anti")
        bins = max(1, rows.count() // GROUP_ROWS)
        found = small.withColumn("bin", F.pmod(F.xxhash64("node"), F.lit(bins))).groupBy("bin").applyInArrow(_compare, "u long, v long")
        found = stage(found, "path-pairs")
        edges = found if edges is None else edges.unionByName(found)
        on = rows.join(large, "node")
        if level == last:
            return edges.unionByName(on.select(F.col("d").alias("u"), F.col("first").alias("v")))
        nodes = stage(on.groupBy("d").agg(F.collect_list("node").alias("nodes")), "path-lists")  # trees * 2^level a set at most
        if nodes.isEmpty():
            return edges
        rows = stage(nodes.join(sets.select("d", "s1", "s2", "tokens"), "d").mapInArrow(_go_on, _NODE), "path-nodes")


# --- exact classes of a cluster ----------------------------------------------------------------


def _near(inter: np.ndarray, a: np.ndarray, b) -> np.ndarray:
    return 100 * inter >= PERCENT * (a + b - inter)


class _Sets:
    """Sets side by side, for comparing one with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([s.size for s in sets], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.names, self.codes = np.unique(np.concatenate(sets), return_inverse=True)

    def near(self, one: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, one)
        at = at[at < self.names.size]
        there = np.zeros(self.names.size, dtype=bool)
        there[at] = self.names[at] == one[: at.size]
        return np.flatnonzero(_near(np.add.reduceat(there[self.codes], self.starts, dtype=np.int64), self.sizes, one.size))


def cluster_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Linked pairs that connect the classes of some sets."""
    if len(sets) == 2:
        inter = np.intersect1d(*sets, assume_unique=True).size
        return [(0, 1)] if _near(inter, sets[0].size, sets[1].size) else []
    held, labels, out = _Sets(sets), np.arange(len(sets)), []
    asked = np.zeros(len(sets), dtype=bool)
    while True:
        main = np.bincount(labels).argmax()
        todo = np.flatnonzero(~asked & (labels != main))
        if not todo.size:
            return out
        asked[todo[0]] = True
        hit = held.near(sets[todo[0]])
        out += [(int(todo[0]), int(h)) for h in hit if labels[h] != labels[todo[0]]]
        labels[np.isin(labels, labels[hit])] = labels[todo[0]]


def _verify(rows: pa.Table) -> pa.Table:
    """(d, root): the classes of the clusters of a task."""
    cluster, d = rows.column("cluster").to_numpy(), rows.column("d").to_numpy()
    order = np.lexsort((d, cluster))
    fresh = np.append(True, (cluster[order][1:] != cluster[order][:-1]) | (d[order][1:] != d[order][:-1]))
    order = order[fresh]  # a repeated row is one
    column = rows.column("text").cast(pa.binary())
    roots = np.arange(order.size)
    at = 0
    for group in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        links = cluster_links([shingles(column[int(k)].as_py()) for k in group])
        if links:
            u, v = np.array(links).T
            roots[at : at + group.size] = at + union(np.arange(group.size), u, v)
        at += group.size
    return pa.table({"d": d[order], "root": d[order][roots]})


def _as_sets(batches):
    for batch in batches:
        sets = pa.array([shingles(t).tobytes() for t in batch.column(3).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["cluster", "tile", "d", "shingles"])


def _against_pivots(rows: pa.Table) -> pa.Table:
    """Links of the pivots of a tile with its sets."""
    pivot = rows.column("pivot").to_numpy(zero_copy_only=False).astype(bool)
    d = rows.column("d").to_numpy()
    sets = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in rows.column("shingles")]
    own = np.flatnonzero(~pivot)
    u, v = [], []
    if own.size:
        held = _Sets([sets[k] for k in own])
        for p in np.flatnonzero(pivot):
            for k in held.near(sets[p]):
                if d[own[k]] != d[p]:
                    u.append(d[p])
                    v.append(d[own[k]])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _solve(rows: pa.Table) -> pa.Table:
    """(pivot, root) of the pivots of one cluster, from pairs of connected ones."""
    u, v = rows.column("u").to_numpy(), rows.column("v").to_numpy()
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    roots = union(np.arange(names.size), ends[: u.size], ends[u.size :])
    return pa.table({"pivot": names, "root": names[roots]})


def _large_classes(members: DataFrame) -> DataFrame:
    """(d, root) in clusters dealt to tiles: ``members`` has cluster, tile, tiles, d and text.

    A class of more than one set has a pivot and is named by one; what connects classes is pairs of
    pivots that one set links to, and these, as few as pivots can have, are solved cluster by cluster.
    """
    sets = members.select("cluster", "tile", "d", "text").mapInArrow(_as_sets, "cluster long, tile long, d long, shingles binary")
    sets = stage(sets.dropDuplicates(["cluster", "tile", "d"]), "large-sets")
    tiles = stage(members.select("cluster", "tiles").distinct(), "large-clusters")
    #: Every set, the pivot that names its class (null: alone so far), and whether it was one itself.
    state = stage(sets.select("cluster", "tile", "d", F.lit(None).cast("long").alias("label"), F.lit(False).alias("asked")), "large-state")
    todo, many = state, PIVOTS
    while True:
        # The first ones by hash: of each tile, then of the cluster.
        best = todo.select("cluster", "tile", "d", F.xxhash64("d").alias("h"))
        for by in (["cluster", "tile"], ["cluster"]):
            best = best.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("h", "d"))).where(F.col("k") <= many)
        pivots = stage(best.select("cluster", "tile", "d"), "pivots")
        if pivots.isEmpty():
            return state.select("d", F.coalesce("label", "d").alias("root"))
        sent = sets.join(pivots, ["cluster", "tile", "d"], "left_semi").join(broadcast_if_small(tiles), "cluster")
        sent = sent.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("cluster", "tile", "d", "shingles", F.lit(True).alias("pivot"))
        rows = sets.withColumn("pivot", F.lit(False)).unionByName(sent)
        found = rows.groupBy("cluster", "tile").applyInArrow(_against_pivots, "u long, v long")
        linked = found.groupBy(F.col("v").alias("d")).agg(F.collect_set("u").alias("pivots"))  # at most the pivots of a round
        asked = pivots.select("d", F.lit(True).alias("now"))
        met = state.join(linked, "d", "left").join(asked, "d", "left").withColumn("asked", F.col("asked") | F.coalesce("now", F.lit(False)))
        own = F.array_compact(F.array("label", F.when(F.col("now"), F.col("d"))))
        met = stage(met.withColumn("names", F.array_union(own, F.coalesce("pivots", F.array().cast("array<long>")))).drop("pivots", "now", "label"), "met")
        pairs = met.where(F.size("names") > 0).select("cluster", F.explode("names").alias("u"), F.array_min("names").alias("v")).distinct()
        solved = broadcast_if_small(stage(pairs.groupBy("cluster").applyInArrow(_solve, "pivot long, root long"), "pivot-roots"))
        state = met.withColumn("pivot", F.array_min("names")).join(solved, "pivot", "left")
        state = stage(state.select("cluster", "tile", "d", F.col("root").alias("label"), "asked"), "large-state")
        sizes = state.groupBy("cluster", F.coalesce("label", "d").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("main")).select("cluster", F.col("main.label").alias("main"))
        todo = state.where("NOT asked").join(broadcast_if_small(stage(main, "main")), "cluster").where(F.coalesce("label", "d") != F.col("main"))
        many *= 8


def classes(docs: DataFrame, sets: DataFrame, repeated: bool) -> DataFrame:
    """(d, root) of every set of a cluster: its class, named by one of its sets."""
    clusters = components(close_pairs(sets))
    clusters = clusters.select(F.col("node").alias("d"), F.col("root").alias("cluster"))
    members = stage(sets.select("d", "rep", "n_shingles").join(clusters, "d"), "members")
    size = members.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / TILE_SHINGLES).cast("long").alias("tiles"))
    large = broadcast_if_small(stage(size.where("tiles > 1"), "cluster-tiles"))  # at most shingles / TILE_SHINGLES
    members = members.join(large, "cluster", "left").select("cluster", F.coalesce("tiles", F.lit(1)).alias("tiles"), "d", F.col("rep").alias("own"))
    rows = texts(docs).withColumn("rep", F.struct("doc_id", text_hash(F.col("text")).alias("text_hash")))
    same = (F.col("rep.text_hash") == F.col("own.text_hash")) & F.col("rep.doc_id").eqNullSafe(F.col("own.doc_id"))
    here = rows.join(broadcast_if_small(stage(members, "named-members")), same).select("cluster", "tiles", "d", "text")
    if repeated:
        here = here.groupBy("cluster", "tiles", "d").agg(F.first("text").alias("text"))
    here = stage(here, "member-texts")
    total, most = here.agg(F.sum(F.octet_length("text")), F.max("tiles")).first()
    bins = max(1, int((total or 0) // (8 * TILE_SHINGLES)))
    small = here.where("tiles = 1").withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)))
    out = small.groupBy("bin").applyInArrow(_verify, "d long, root long")
    if (most or 0) < 2:
        return out
    return out.unionByName(_large_classes(here.where("tiles > 1").withColumn("tile", F.pmod(F.xxhash64("d"), F.col("tiles")))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    own = texts(docs).withColumn("text_hash", text_hash(F.col("text")))
    signed = stage(own.mapInArrow(_sign, _SIGNED), "signed")
    repeats = signed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    sets = signed.where("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("first_doc"),
        F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.count(F.lit(1)).alias("n_rows"),
        *[F.first(c).alias(c) for c in ("n_shingles", "tokens", "s1", "s2")],
    )
    # Numbered once, as the stage is written.
    sets = stage(sets.withColumn("d", F.monotonically_increasing_id()), "sets")
    roots = stage(classes(docs, sets, repeats > 1), "set-roots")
    named = stage(sets.select("d", "k1", "k2", "n_rows", "first_doc").join(roots, "d", "left").withColumn("root", F.coalesce("root", "d")).drop("d"), "named-sets")
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # Most classes are one set, which knows its smallest id.
    several = stage(least.where("n > 1"), "classes")
    joined = join_counted(named, several, ["root"], "n", "left").select("k1", "k2", "n_rows", F.coalesce("component_id", "first_doc").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "k1", "k2")
    out = join_counted(rows.where("n_shingles > 0"), stage(joined, "set-classes"), ["k1", "k2"], "n_rows")
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id")


@query("op11_chosen_path")
def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
