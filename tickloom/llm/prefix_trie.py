"""The trie of conversation prefixes, from ROLLUP over positional turn columns.

A turn becomes an id (its digest and its words), and WIDTH turns in a row become one row of
columns t1..tWIDTH, a block. One ROLLUP over these columns, with grouping_id as the depth,
aggregates all prefixes of all blocks together; longer conversations go on in further blocks,
keyed by the node that the block before ends in. A node's key is the exclusive or of a 128-bit hash
of each (position, turn) up to it, so blocks get their keys from a running aggregate and no
conversation has to be gathered in one task.

What a node needs from its subtree is a sum over its members, so a second ROLLUP gives it:

- a childless node's members all end in it, so its smallest member stands for it, and the leaves
  under a node are as many as its members that stand for one;
- (n_convs - 1) x words, summed over the subtree, counts the words of each member's turns in all
  nodes where it isn't the smallest member. Once a conversation is a node's smallest member it is
  so in all deeper ones, so these turns end at one depth: a running sum within the conversation.

The second one reads the shared part of each conversation alone: a node with one member has one
leaf and saves nothing.

Edge cases: turns are ordered by turn (null first), ties by the SHA-256 of role and text; null
roles and texts are empty; repeated rows are turns of their own; rows without a conv_id belong to
no conversation and are left out; a conversation of any length, and a turn, an end or a child
list shared by any number of them, is spread over tasks; other columns are ignored, whatever
their names; an empty table has no conversation and no node, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.sequence import with_position
from ..session import stage
from .common import WORD, join_counted, query, table

WIDTH = 8
#: A conversation takes up to this many turns, less one, from the first one of its family.
HEAD, FAMILY = 4, 20
#: Blocks of one conversation that are aggregated side by side, and ids that are joined to one text.
RUN, ID_BITS = 1024, 12
KEY = ["depth", "ka", "kb"]
_COLUMNS = [f"t{j}" for j in range(1, WIDTH + 1)]


def turn_id(role: Column, text: Column) -> Column:
    """12 bytes of the SHA-256 of role and text, then the text's words as four bytes."""
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(told, 1, 24), F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0")))


def _words(id_: Column) -> Column:
    return F.conv(F.hex(F.substring(id_, 13, 4)), 16, 10).cast("long")


def _hashes(id_: Column, position: Column) -> tuple[Column, Column]:
    return F.xxhash64(id_, position), F.xxhash64(F.lit("trie"), position, id_)


def taken(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id) of all rebuilt turns, and (conv_id, n_blocks) of all conversations."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(text("role"), text("text")).alias("id")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("id")]
    ranged = stage(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    own = stage(with_position(ranged, ["conv_id"], order, [F.col("part")]).select("conv_id", "pos", "id"), "own-turns")
    counts = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    heads = own.where(F.col("pos") < HEAD - 1).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("ids"))
    convs = counts.select("conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), taken(F.col("conv_id")).alias("h"))
    ids = F.coalesce(F.slice(F.transform("ids", lambda x: x["id"]), F.lit(1), F.col("h")), F.array().cast("array<binary>"))
    convs = convs.join(heads, "base", "left").select("conv_id", "n_own", "h", ids.alias("ids"))
    convs = stage(convs.withColumn("short", F.col("h") - F.size("ids")), "families")
    first = convs.select("conv_id", F.posexplode("ids").alias("pos", "id")).select("conv_id", F.col("pos").cast("long").alias("pos"), "id")
    later = join_counted(own.where(F.col("pos") >= taken(F.col("conv_id"))), convs.where("short > 0").select("conv_id", "n_own", "short"), ["conv_id"], "n_own", "left")
    later = later.select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "id")
    length = F.size("ids") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    sizes = convs.select("conv_id", F.greatest(F.ceil(length / WIDTH), F.lit(1)).cast("long").alias("n_blocks"))
    return first.unionByName(later), sizes


def _running(rows: DataFrame, sums: dict[str, tuple], backwards: bool = False) -> DataFrame:
    """Adds each aggregate over the earlier (later) blocks of the conversation, run by run."""
    order = lambda c: F.col(c).desc() if backwards else F.col(c)
    rows = rows.withColumn("run", F.floor(F.col("block") / RUN))
    over = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    per_run = rows.groupBy("conv_id", "run").agg(*[f(value).alias(f"run_{name}") for name, (f, value, _) in sums.items()])
    before = over(W.partitionBy("conv_id").orderBy(order("run")))
    per_run = per_run.select("conv_id", "run", *[f(f"run_{name}").over(before).alias(f"run_{name}") for name, (f, _, _) in sums.items()])
    inside = over(W.partitionBy("conv_id", "run").orderBy(order("block")))
    rows = rows.join(per_run, ["conv_id", "run"])
    none = F.lit(0).cast("long")
    joined = {name: both(F.coalesce(f"run_{name}", none), F.coalesce(f(value).over(inside), none)) for name, (f, value, both) in sums.items()}
    return rows.withColumns(joined).drop("run", *[f"run_{name}" for name in sums])


def blocks(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, block, t1..tWIDTH (null beyond the end), own and prior xors of the key, and n turns."""
    rows = turns.withColumn("block", F.floor(F.col("pos") / WIDTH)).withColumn("slot", F.col("pos") % WIDTH)
    rows = rows.select("conv_id", "block", "slot", "id", *[h.alias(n) for h, n in zip(_hashes(F.col("id"), F.col("pos")), ("ha", "hb"))])
    none = F.lit(0).cast("long")
    # A conversation without turns has a first block too.
    start = sizes.select("conv_id", none.alias("block"), F.lit(None).cast("long").alias("slot"), F.lit(None).cast("binary").alias("id"), none.alias("ha"), none.alias("hb"))
    rows = rows.unionByName(start).groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("slot") == j, F.col("id"))).alias(c) for j, c in enumerate(_COLUMNS)],
        F.bit_xor("ha").alias("xa"),
        F.bit_xor("hb").alias("xb"),
        F.count("id").alias("n"),
    )
    both = lambda a, b: a.bitwiseXOR(b)
    return _running(stage(rows, "turn-blocks"), {"pa": (F.bit_xor, "xa", both), "pb": (F.bit_xor, "xb", both)})


def _rollup(rows: DataFrame, sums: str) -> DataFrame:
    """Aggregates of every prefix of every block: KEY, last (its last turn) and the sums."""
    ts = ", ".join(_COLUMNS)
    found = rows.sparkSession.sql(
        f"SELECT block, pa, pb, {ts}, {WIDTH} - bit_count(grouping_id() & {(1 << WIDTH) - 1}) AS at, {sums} FROM {{rows}} GROUP BY block, pa, pb, ROLLUP ({ts})", rows=rows
    )
    # Past its end a conversation has nulls that aren't rolled up; a later block's empty prefix is the node before it.
    there = sum((F.col(c).isNotNull().cast("int") for c in _COLUMNS), F.lit(0))
    found = found.where((there == F.col("at")) & ((F.col("at") > 0) | (F.col("block") == 0)))
    none = F.lit(0).cast("long")
    # The empty prefix is the root, whatever the keys of its rows.
    ka, kb = F.col("pa"), F.col("pb")
    for j, c in enumerate(_COLUMNS):
        for_a, for_b = _hashes(F.col(c), F.col("block") * WIDTH + j)
        ka = ka.bitwiseXOR(F.when(F.col(c).isNotNull(), for_a).otherwise(none))
        kb = kb.bitwiseXOR(F.when(F.col(c).isNotNull(), for_b).otherwise(none))
    out = found.withColumns({"depth": F.col("block") * WIDTH + F.col("at"), "ka": ka, "kb": kb})
    return out.withColumn("last", F.get(F.array(*_COLUMNS), F.col("at") - 1)).drop("block", "pa", "pb", *_COLUMNS)


def _streamed(batches):
    """One digest per key of rows sorted by key and bucket, with no key's ids held together."""
    held, state = None, None
    done: list[list] = [[], [], [], []]

    def close():
        for column, value in zip(done, (*held, state.hexdigest())):
            column.append(value)

    for batch in batches:
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != held:
                if held:
                    close()
                held, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if held:
        close()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, types)], names=[*KEY, "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """KEY and the digest of the conversations that end there, ids in order."""
    bucket = F.expr(f"shiftright(conv_id, {ID_BITS})")
    texts = rows.groupBy(*KEY, bucket.alias("bucket")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    texts = stage(texts, "end-ids")
    each = texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("buckets"), F.max("ids").alias("ids"))
    each = stage(each, "ends")
    several = texts.join(each.where("buckets > 1").select(*KEY), KEY, "left_semi").select(*KEY, "bucket", "ids")
    several = several.repartition(*KEY).sortWithinPartitions(*KEY, "bucket").select(*KEY, "ids")
    told = several.mapInArrow(_streamed, "depth long, ka long, kb long, ends_sha256 string")
    return each.where("buckets = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256")).unionByName(told)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, sizes = rebuilt(conversations)
    sizes = stage(sizes, "conversation-sizes")
    rows = stage(blocks(stage(turns, "rebuilt"), sizes), "keyed-blocks")
    nodes = _rollup(rows, "COUNT(*) AS n_convs, MIN(conv_id) AS conv_id")
    up = _hashes(F.col("last"), F.col("depth") - 1)
    parent = [F.when(F.col("depth") > 0, c).alias(n) for c, n in zip((F.col("depth") - 1, F.col("ka").bitwiseXOR(up[0]), F.col("kb").bitwiseXOR(up[1])), ("up_depth", "up_a", "up_b"))]
    nodes = stage(nodes.select(*KEY, *parent, "conv_id", "n_convs"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_depth").alias("depth"), F.col("up_a").alias("ka"), F.col("up_b").alias("kb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")

    # The depths from which each conversation is the smallest, and the only, member; whether it stands for a leaf.
    own = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("smallest_from"),
        F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).alias("alone_from"),
        F.max((F.col("n_children") == 0).cast("int")).alias("leaf"),
    )
    never = F.lit((1 << 62)).cast("long")
    own = sizes.join(own, "conv_id", "left").select(
        "conv_id", "n_blocks", F.coalesce("smallest_from", never).alias("smallest_from"), F.coalesce("alone_from", never).alias("alone_from"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    shared = join_counted(rows, stage(own, "owners"), ["conv_id"], "n_blocks")
    depth = lambda j: F.col("block") * WIDTH + j
    shared = shared.where(depth(F.when(F.col("block") == 0, 0).otherwise(1)) < F.col("alone_from"))
    saved = [F.when(depth(j) < F.col("smallest_from"), F.coalesce(_words(F.col(c)), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")) for j, c in enumerate(_COLUMNS, 1)]
    shared = shared.withColumns({c: F.when(depth(j) < F.col("alone_from"), F.col(c)) for j, c in enumerate(_COLUMNS, 1)} | {f"s{j}": x for j, x in enumerate(saved, 1)})
    shared = shared.withColumn("s", sum((F.col(f"s{j}") for j in range(2, WIDTH + 1)), F.col("s1")))
    shared = _running(stage(shared, "shared-blocks"), {"tail": (F.sum, "s", lambda a, b: a + b)}, backwards=True)
    suffix = [" + ".join([*(f"s{i}" for i in range(max(1, j), WIDTH + 1)), "tail"]) for j in range(WIDTH + 1)]
    below = _rollup(shared, "SUM(leaf) AS n_leaves, ARRAY(" + ", ".join(f"SUM({x})" for x in suffix) + ") AS saved")
    below = below.select(*KEY, "n_leaves", F.get("saved", F.col("at")).alias("saved_tokens"))

    closed = rows.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("xa").alias("ka"), F.bit_xor("xb").alias("kb"))
    out = nodes.join(below, KEY, "left").join(ends(stage(closed, "conversation-ends")), KEY, "left")
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up_depth"), F.col("ka").alias("up_a"), F.col("kb").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of"))
    out = join_counted(stage(out, "nodes-below"), stage(parents, "parents"), ["up_depth", "up_a", "up_b"], "of", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS own FROM t GROUP BY conv_id
), c AS (
  SELECT conv_id, own, CAST(conv_id - conv_id % {FAMILY} AS BIGINT) AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % {HEAD} AS h
  FROM o
), r AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS seq
  FROM c LEFT JOIN o b ON b.conv_id = c.base
), p AS (
  SELECT conv_id, len(seq) AS full_depth, d AS depth, list_slice(seq, 1, d) AS path FROM r, unnest(range(0, len(seq) + 1)) AS u(d)
), n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CASE WHEN depth = full_depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends,
         CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].t, '{WORD}')) END AS words
  FROM p GROUP BY depth, path
), k AS (
  SELECT n.*, (SELECT count(*) FROM n y WHERE y.depth = n.depth + 1 AND list_slice(y.path, 1, n.depth) = n.path) AS n_children FROM n
), s AS (
  SELECT x.depth, x.path, sum((y.n_convs - 1) * y.words) AS saved, count(*) FILTER (y.n_children = 0) AS leaves
  FROM k x JOIN k y ON y.depth >= x.depth AND list_slice(y.path, 1, x.depth) = x.path GROUP BY x.depth, x.path
)
SELECT CAST(k.conv_id AS BIGINT) AS conv_id, CAST(k.depth AS BIGINT) AS depth, CAST(up.conv_id AS BIGINT) AS parent_conv_id, CAST(k.n_convs AS BIGINT) AS n_convs,
       CAST(k.n_children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM k JOIN s ON k.depth = s.depth AND k.path = s.path LEFT JOIN n up ON up.depth = k.depth - 1 AND up.path = list_slice(k.path, 1, k.depth - 1)
"""


@query("op13_prefix_trie", ORACLE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
