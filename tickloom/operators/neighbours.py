"""Exact nearest neighbours without a cross join of rows.

Both sides are hashed into blocks of bounded size. Each pair of blocks meets in one task as two
matrices; a task returns only the best ``k`` per query, never the pairs. Memory per task is fixed,
and a hot group simply has more blocks.

Groups of many blocks are searched through an index of lower bounds (``Cells``). A row's summary is
its coordinates along a few orthonormal directions, whose distance is never more than that of the
rows, and its distances to a few pivots. Targets are put into cells by a tree that splits the
coordinates at medians, and each cell has the box of its summaries. A query searches the nearest
boxes first, which bounds how far its neighbours can be. Its summary then visits the other boxes that
are closer than this bound, and its vector only those cells that have a row whose summary is. Rows of up to SUMMARY numbers are their own coordinates, so
the tree is then a k-d tree over the rows. The result is that of a search of everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import small, stage

BLOCK_ROWS = 4096
#: Block pairs of a group from which an index pays for its extra passes.
PRUNE_FROM = 16
#: Rows of a cell, and cells of an index at most; beyond them, cells get larger.
CELL_ROWS, MAX_CELLS = 512, 1 << 14
#: Coordinates and pivots of a summary, rows that the directions are taken from, and rows per cell that the tree is.
SUMMARY, PIVOTS, BASIS_ROWS, PER_CELL = 16, 16, 4096, 8
#: Cells a query searches first, and groups that get an index at most, the largest ones.
FIRST, MAX_GROUPS = 3, 4096
_STEP = 512


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a 2-D array."""
    flat = np.concatenate([np.asarray(chunk.flatten()) for chunk in column.chunks]) if column.num_chunks else np.empty(0)
    return flat.reshape(len(column), -1)


def _direct(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    gap = query - target
    return np.sqrt((gap * gap).sum(axis=-1))


def block_nearest(query: np.ndarray, target: np.ndarray, k: int, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the ``k`` nearest rows of ``target``; infinite where there are fewer.

    A matrix product on rows centred at the targets' mean gives squared distances up to a
    known error. Every target within twice that error of the k-th smallest is measured by
    direct differences, so none is lost and equal rows are at distance exactly zero.
    """
    centre = target.mean(axis=0)
    q, t = query - centre, target - centre
    k = min(k, len(target))
    tt = (t * t).sum(axis=1)
    pick, dist = np.zeros((len(q), k), dtype=np.int64), np.full((len(q), k), np.inf)
    for lo in range(0, len(q), _STEP):
        part = q[lo : lo + _STEP]
        qq = (part * part).sum(axis=1)
        squared = qq[:, None] + tt[None, :] - 2.0 * part @ t.T
        if same is not None:
            squared[same[lo : lo + _STEP]] = np.inf
        kth = np.partition(squared, k - 1, axis=1)[:, k - 1]
        # Rounding of a sum of products, and of the centring, over all dimensions.
        slack = 8.0 * np.finfo(float).eps * (q.shape[1] + 4) * (np.sqrt(qq) + np.sqrt(tt.max())) ** 2
        slack += 8.0 * np.finfo(float).eps * np.abs(centre).max() * (np.sqrt(qq) + np.sqrt(tt.max())) * np.sqrt(q.shape[1])
        near = squared <= (kth + 2.0 * slack)[:, None]
        near &= np.isfinite(squared)
        most = max(k, int(near.sum(axis=1).max(initial=0)))
        if most > 4 * (k + 8):  # many ties in some rows: measure row by row
            for i in range(len(part)):
                j = np.flatnonzero(near[i])
                d = _direct(query[lo + i], target[j])
                order = np.argsort(d, kind="stable")[:k]
                pick[lo + i, : order.size], dist[lo + i, : order.size] = j[order], d[order]
            continue
        masked = np.where(near, squared, np.inf)
        few = np.sort(np.argpartition(masked, min(most, masked.shape[1]) - 1, axis=1)[:, :most], axis=1)
        d = np.empty(few.shape)
        for a in range(0, len(part), 64):
            d[a : a + 64] = _direct(query[lo + a : lo + a + 64][: len(part) - a, None, :], target[few[a : a + 64]])
        d[~np.take_along_axis(near, few, axis=1)] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        pick[lo : lo + _STEP], dist[lo : lo + _STEP] = np.take_along_axis(few, order, axis=1), np.take_along_axis(d, order, axis=1)
    return pick, dist


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    keys: list[str],
    query_id: str,
    target_id: str,
    k: int = 1,
    vec: str = "vec",
    skip_same_id: bool = False,
    block_rows: int = BLOCK_ROWS,
    prune_from: int = PRUNE_FROM,
) -> DataFrame:
    """``(keys, query_id, target_id, distance, rank)`` of the k nearest targets per query.

    Queries and targets only meet inside equal ``keys``. Ids must be whole numbers and
    unique per side and key.
    """
    keys = list(keys)
    args = (query_id, target_id, k, vec, skip_same_id)
    if keys:
        found = _grouped(queries, targets, keys, *args, block_rows, prune_from)
    else:
        blocks = [max(1, -(-df.count() // block_rows)) for df in (queries, targets)]
        if blocks[0] * blocks[1] < prune_from:
            found = _meet(queries, targets, [], *args, F.lit(blocks[0]), F.lit(blocks[1]))
        else:
            one = F.lit(0).alias("group")
            search = Cells(queries.select(one, query_id, vec), targets.select(one, target_id, vec), *args, block_rows)
            found = search.found().drop("group")
    if k == 1:
        best = found.groupBy(*keys, query_id).agg(F.min(F.struct("distance", target_id)).alias("__best"))
        return best.select(*keys, query_id, f"__best.{target_id}", "__best.distance", F.lit(1).alias("rank"))
    by_query = W.partitionBy(*keys, query_id).orderBy("distance", target_id)
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _sizes(queries: DataFrame, targets: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """(keys, __nq, __nt): blocks of both sides, for keys that both have."""
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    return count(queries, "__nq").join(count(targets, "__nt"), keys)


def _by_key(queries, targets, keys, query_id, target_id, k, vec, skip_same_id, block_rows) -> DataFrame:
    # One row per key group; its true size decides how it is joined.
    grid = small(_sizes(queries, targets, keys, block_rows), "grid")
    return _meet(queries.join(grid, keys), targets.join(grid, keys), keys, query_id, target_id, k, vec, skip_same_id, F.col("__nq"), F.col("__nt"))


def _grouped(queries, targets, keys, query_id, target_id, k, vec, skip_same_id, block_rows, prune_from) -> DataFrame:
    """Groups of many block pairs go through an index, all others are searched whole."""
    args = (query_id, target_id, k, vec, skip_same_id, block_rows)
    pairs = F.col("__nq").cast("long") * F.col("__nt")
    sizes = stage(_sizes(queries, targets, keys, block_rows), "group-sizes")
    large = sizes.where(pairs >= prune_from).orderBy(pairs.desc(), *keys).limit(MAX_GROUPS).select(*keys).collect()
    if not large:
        return _by_key(queries, targets, keys, *args)
    schema = T.StructType([*[sizes.schema[c] for c in keys], T.StructField("group", T.IntegerType())])
    named = F.broadcast(queries.sparkSession.createDataFrame([(*r, g) for g, r in enumerate(large)], schema))  # MAX_GROUPS rows at most
    rest = [df.join(named, keys, "left_anti") for df in (queries, targets)]
    own, held = queries.join(named, keys), targets.join(named, keys)
    found = Cells(own.select("group", query_id, vec), held.select("group", target_id, vec), *args).found().join(named, "group")
    names = [*keys, query_id, target_id, "distance"]
    return _by_key(*rest, keys, *args).select(*names).unionByName(found.select(*names))


def _meet(queries, targets, keys, query_id, target_id, k, vec, skip_same_id, n_q: Column, n_t: Column) -> DataFrame:
    """The best ``k`` of every pair of blocks, inside equal keys."""
    block = lambda row_id, n: F.pmod(F.xxhash64(row_id), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # Fresh key names per side: both sides may come from the same table.
    left_keys, right_keys = [f"__q_{c}" for c in keys], [f"__t_{c}" for c in keys]
    renamed = lambda names: [F.col(c).alias(n) for c, n in zip(keys, names)]
    left = queries.select(
        *renamed(left_keys), F.col(query_id).cast("long").alias("__qid"), F.col(vec).alias("__vec"), block(query_id, n_q).alias("__qb"), upto(n_t).alias("__tb")
    )
    right = targets.select(
        *renamed(right_keys), F.col(target_id).cast("long").alias("__tid"), F.col(vec).alias("__vec"), block(target_id, n_t).alias("__tb"), upto(n_q).alias("__qb")
    )
    schema = T.StructType(
        [queries.schema[c] for c in keys]
        + [T.StructField(query_id, T.LongType()), T.StructField(target_id, T.LongType()), T.StructField("distance", T.DoubleType())]
    )
    names = schema.fieldNames()
    arrow_schema = to_arrow_schema(schema)

    def search(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
        if q.num_rows == 0 or t.num_rows == 0:
            return arrow_schema.empty_table()
        qid, tid = np.asarray(q["__qid"]), np.asarray(t["__tid"])
        same = qid[:, None] == tid[None, :] if skip_same_id else None
        pick, dist = block_nearest(matrix(q["__vec"]), matrix(t["__vec"]), k, same)
        keep = np.isfinite(dist).ravel()
        cols = [pa.array([v.as_py()] * int(keep.sum())) for v in key[: len(keys)]]
        cols += [
            pa.array(np.repeat(qid, dist.shape[1])[keep]),
            pa.array(tid[pick].ravel()[keep]),
            pa.array(dist.ravel()[keep]),
        ]
        return pa.table(cols, names=names).cast(arrow_schema)

    blocks = ["__qb", "__tb"]
    return left.groupBy(*left_keys, *blocks).cogroup(right.groupBy(*right_keys, *blocks)).applyInArrow(search, schema)


def _tree(points: np.ndarray, cells: int, nodes: list, leaves: list) -> int:
    """Splits ``points`` at medians, widest coordinate first; the number of the (sub)tree's node."""
    at = len(nodes)
    nodes.append(None)
    spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
    dim = int(spread.argmax())
    cut = np.median(points[:, dim]) if len(points) else 0.0
    left = points[:, dim] < cut if len(points) else np.zeros(0, bool)
    if cells < 2 or not left.any() or left.all():
        leaves.append(at)
        nodes[at] = (-1, 0.0, len(leaves) - 1, 0)
        return at
    nodes[at] = (dim, float(cut), _tree(points[left], cells // 2, nodes, leaves), _tree(points[~left], cells - cells // 2, nodes, leaves))
    return at


def _bounds(batch, cells, groups, n, low, high, width, slack):
    """(rows of the batch, their boxes, lower bounds of the distances) of one group, some rows at a time."""
    group = batch.column(batch.schema.get_field_index("group")).to_numpy(zero_copy_only=False)
    x = np.asarray(batch.column(batch.schema.get_field_index("summary")).flatten()).reshape(batch.num_rows, -1)
    for g in np.unique(group):
        mine, boxes = np.flatnonzero(group == g), np.flatnonzero(groups == g)
        step = max(1, (1 << 22) // max(1, boxes.size * x.shape[1]))
        for at in range(0, mine.size, step) if boxes.size else ():
            rows = mine[at : at + step]
            gap = np.maximum(np.maximum(low[boxes][None] - x[rows, None, :], x[rows, None, :] - high[boxes][None]), 0.0)
            least = np.sqrt((gap[:, :, :width] ** 2).sum(axis=2))
            if gap.shape[2] > width:
                least = np.maximum(least, gap[:, :, width:].max(axis=2))
            yield rows, boxes, np.maximum(least * (1 - 1e-9) - slack, 0.0)


class Cells:
    """The index of lower bounds over (group, id, vector) rows of both sides."""

    def __init__(self, queries, targets, query_id, target_id, k, vec, skip_same_id, block_rows, cell_rows: int | None = None):
        self.names, self.k, self.skip, self.block_rows = (query_id, target_id), k, skip_same_id, block_rows
        few = targets.orderBy(F.xxhash64(target_id), target_id).limit(BASIS_ROWS).select(vec).collect()
        sample = np.array([r[0] for r in few], dtype=float)
        self.centre = sample.mean(axis=0)
        width = sample.shape[1]
        if width <= SUMMARY:
            self.basis, self.pivots = np.eye(width), sample[:0]
        else:
            spread = sample - self.centre
            self.basis, self.pivots = np.linalg.eigh(spread.T @ spread)[1][:, ::-1][:, :SUMMARY], sample[:PIVOTS]
        self.own, self.held = self._summed(queries, query_id, vec, "queries"), self._summed(targets, target_id, vec, "targets")
        self._grow(cell_rows or CELL_ROWS)
        first = self._first()
        self.first = stage(first, "first-cells")
        cells = self.held.select("group", F.col("id").alias("target"), "vec", "cell")
        args = ("id", "target", k, "vec", skip_same_id, block_rows)
        visits = self.first.select("group", "id", "vec", F.explode("cells").alias("cell"))
        near = stage(_by_key(visits, cells, ["group", "cell"], *args).drop("cell"), "first-found")
        by_query = W.partitionBy("group", "id").orderBy("distance", "target")
        bound = near.withColumn("__r", F.row_number().over(by_query)).where(F.col("__r") == k).select("group", "id", F.col("distance").alias("bound"))
        rest = self.first.drop("vec").join(bound, ["group", "id"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        screened = stage(self._screened(stage(self._rest(rest), "near-boxes")), "near-rows")
        self.more = stage(screened.join(self.own.select("group", "id", "vec"), ["group", "id"]), "further-cells")
        self._near, self._later = near, _by_key(self.more, cells, ["group", "cell"], *args).drop("cell")

    def found(self) -> DataFrame:
        """(group, query_id, target_id, distance): the best of every cell that can hold neighbours."""
        both = self._near.unionByName(self._later)
        return both.select("group", F.col("id").alias(self.names[0]), F.col("target").alias(self.names[1]), "distance")

    def _summed(self, rows: DataFrame, row_id: str, vec: str, name: str) -> DataFrame:
        centre, basis, pivots = self.centre, self.basis, self.pivots

        def summaries(batches):
            for batch in batches:
                x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
                parts = [(x - centre) @ basis, *[_direct(x, p)[:, None] for p in pivots]]
                flat = np.concatenate(parts, axis=1)
                offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
                summary = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, summary], names=["group", "id", "vec", "summary"])

        own = rows.select("group", F.col(row_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
        return stage(own.mapInArrow(summaries, "group int, id long, vec array<double>, summary array<double>"), name)

    def _grow(self, cell_rows: int) -> None:
        """The tree of each group, the targets' cells, and the boxes of the cells."""
        spark, width = self.held.sparkSession, self.basis.shape[1]
        sizes = {r.group: r.n for r in self.held.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_GROUPS rows at most
        total = sum(sizes.values())
        cell_rows = max(cell_rows, -(-total // MAX_CELLS))
        share = min(1.0, PER_CELL / cell_rows)
        some = self.held.where(F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        points: dict[int, list] = {g: [] for g in sizes}
        for r in some.select("group", F.slice("summary", 1, width).alias("x")).collect():  # PER_CELL * MAX_CELLS in the mean
            points[r.group].append(r.x)
        nodes: list = []
        leaves: list = []
        roots = {g: _tree(np.array(x, dtype=float).reshape(-1, width), -(-sizes[g] // cell_rows), nodes, leaves) for g, x in sorted(points.items())}
        shared = spark.sparkContext.broadcast((roots, *(np.array(c) for c in zip(*nodes))))

        def place(batches):
            roots, dims, cuts, left, right = shared.value
            for batch in batches:
                x = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
                at = np.array([roots[g] for g in batch.column(0).to_pylist()], dtype=np.int64)
                while (inner := dims[at] >= 0).any():
                    go = at[inner]
                    at[inner] = np.where(x[inner, dims[go]] < cuts[go], left[go], right[go])
                cell = pa.array(left[at].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=["group", "id", "vec", "summary", "cell"])

        schema = "group int, id long, vec array<double>, summary array<double>, cell int"
        self.held = stage(self.held.mapInArrow(place, schema), "cells")
        sides = [f(F.get("summary", F.lit(j))) for f in (F.min, F.max) for j in range(width + len(self.pivots))]
        boxes = self.held.groupBy("cell").agg(F.min("group").alias("group"), F.count(F.lit(1)).alias("n"), F.array(*sides).alias("sides"))
        found = boxes.orderBy("cell").collect()  # MAX_CELLS boxes at most, in the mean
        sides = np.array([r.sides for r in found], dtype=float).reshape(len(found), 2, -1)
        cells, groups, n = (np.array([r[c] for r in found], dtype=np.int64) for c in ("cell", "group", "n"))
        top = np.abs(sides[:, :, :width]).max(initial=0.0) * np.sqrt(width)
        slack = 1e-9 * top + 8 * np.finfo(float).eps * np.abs(self.centre).max() * np.sqrt(self.centre.size)
        self.boxes = spark.sparkContext.broadcast((cells, groups, n, sides[:, 0], sides[:, 1], width, slack))

    def _first(self) -> DataFrame:
        """Adds to each query the nearest boxes that together have enough targets."""
        need, boxes = max(1, self.k + int(self.skip)), self.boxes

        def choose(batches):
            for batch in batches:
                chosen: list = [[] for _ in range(batch.num_rows)]
                cells, n = boxes.value[0], boxes.value[2]
                for rows, at, least in _bounds(batch, *boxes.value):
                    order = np.argsort(least, axis=1, kind="stable")
                    upto = np.maximum(FIRST, 1 + (np.cumsum(n[at][order], axis=1) < need).sum(axis=1))
                    for r, o, m in zip(rows, order, upto):
                        chosen[r] = cells[at[o[:m]]].tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))], names=["group", "id", "vec", "summary", "cells"])

        return self.own.mapInArrow(choose, "group int, id long, vec array<double>, summary array<double>, cells array<int>")

    def _rest(self, queries: DataFrame) -> DataFrame:
        """(group, id, cell, summary, bound): every other box that is not farther than the query's bound."""
        boxes = self.boxes

        def choose(batches):
            for batch in batches:
                column = lambda name: batch.column(batch.schema.get_field_index(name))
                bound, seen, cells = column("bound").to_numpy(zero_copy_only=False), column("cells").to_pylist(), boxes.value[0]
                for rows, at, least in _bounds(batch, *boxes.value):
                    open_ = least <= bound[rows][:, None]
                    for k, r in enumerate(rows):
                        open_[k] &= ~np.isin(cells[at], seen[r])
                    row, box = np.nonzero(open_)
                    take = pa.array(rows[row])
                    columns = [column("group").take(take), column("id").take(take), pa.array(cells[at[box]].astype(np.int32)), column("summary").take(take), column("bound").take(take)]
                    yield pa.RecordBatch.from_arrays(columns, names=["group", "id", "cell", "summary", "bound"])

        names = ["group", "id", "summary", "cells", "bound"]
        return queries.select(*names).mapInArrow(choose, "group int, id long, cell int, summary array<double>, bound double")

    def _screened(self, visits: DataFrame) -> DataFrame:
        """(group, id, cell) of the visits whose cell has a row that may be as near as the bound, by its summary."""
        width, slack = self.boxes.value[-2:]
        grid = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / self.block_rows).cast("int").alias("blocks"))
        grid = small(grid, "visit-blocks")
        left = visits.join(grid, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
        right = self.held.select("cell", F.col("summary").alias("held")).join(grid, "cell")
        right = right.select("cell", "held", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def screen(queries: pa.Table, rows: pa.Table) -> pa.Table:
            near = np.zeros(queries.num_rows, dtype=bool)
            if queries.num_rows and rows.num_rows:
                x, y, bound = matrix(queries["summary"]), matrix(rows["held"]), queries["bound"].to_numpy()
                step = max(1, (1 << 22) // y.size)
                for at in range(0, len(x), step):
                    gap = np.abs(x[at : at + step, None, :] - y[None])
                    least = np.sqrt((gap[:, :, :width] ** 2).sum(axis=2))
                    if gap.shape[2] > width:
                        least = np.maximum(least, gap[:, :, width:].max(axis=2))
                    near[at : at + step] = (least * (1 - 1e-9) - slack <= bound[at : at + step, None]).any(axis=1)
            return queries.select(["group", "id", "cell"]).filter(pa.array(near))

        blocks = [F.col("cell"), F.col("block").cast("long")]
        return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(screen, "group int, id long, cell int")
