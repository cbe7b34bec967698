"""How five filters interact: every order of them, folded over the masks of failed filters.

Each document becomes a mask of the filters it fails. Documents are counted by (part, mask, label
flags), at most 128 cells a part whatever the input, and only these cells meet the 120 orders:
each cell folds across the array of orders with ``transform`` and ``aggregate`` and gives 600
structs (order by order, step by step) weighted by its count, and a part's cells are merged
by elementwise sums. The orders are a literal array inside the expression, 120 x 5 numbers.

Filter E needs the smallest id of each text table-wide. Texts meet as SHA-256 digests, counted by
(digest, doc_id, part, mask, flags), then by (digest, part, mask, flags) on the map side, so that
no task sees the copies of a text one by one.

Edge cases: a null text is empty (0 words, 0 code points), a null source is the part "" together
with empty sources; a null doc_id has no smaller id and is none, so such a row never fails E; rows
that repeat an id with one text don't make each other fail; an id labelled more than once counts
as good (toxic) if any of its rows says so, labels without an id count for none; texts of any
length are read whole; other columns are ignored, whatever their names; no documents give no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage
from .common import GAPS, WORD, join_counted, let, query, table

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Fixed values of the filters B, C and D.
DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 2, "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(filter_: str) -> int:
    return 1 << FILTERS.index(filter_)


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself."""
    ws = F.array_remove(F.split(text, GAPS), "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    long = lambda c: c.cast("long")
    flag = lambda cond, name: F.when(cond, F.lit(_bit(name))).otherwise(F.lit(0))
    by_words = let(
        ws,
        lambda w: flag(F.size(w) < MIN_WORDS, "A")
        + flag(100 * long(F.size(F.array_distinct(w))) < DISTINCT_PERCENT * long(F.size(w)), "B"),
    )
    return by_words + flag(100 * long(upper) > UPPER_PERCENT * long(F.length(text)), "C") + flag(text.rlike(SYMBOLS), "D")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: how many documents of a part fail exactly the mask's filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        own_mask(text).alias("mask"),
    )
    # One row of each (id, text, part): a null or much repeated id is summed before it meets the labels.
    rows = stage(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "filter-masks")
    by_id = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows_of"))
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    flags = by_id.where("doc_id IS NOT NULL").join(flags, "doc_id", "left").select("doc_id", "rows_of", zero("good"), zero("toxic"))
    rows = join_counted(rows, stage(flags, "label-flags"), ["doc_id"], "rows_of", how="left")
    groups = rows.groupBy("digest", "part", "mask", zero("good"), zero("toxic")).agg(
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("n_unnamed"),
        F.sum("n").alias("n"),
    )
    groups = stage(groups, "filter-groups")
    # Texts of one group alone need no other group's smallest id.
    least = groups.groupBy("digest").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("groups"))
    groups = join_counted(groups, stage(least, "filter-texts"), ["digest"], "groups")
    first = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0)) + F.coalesce("n_unnamed", F.lit(0))
    split = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), first.alias("n")),
            F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - first).alias("n")),
        )
    )
    cells = groups.select("part", "good", "toxic", split.alias("cell")).where("cell.n > 0")
    return cells.groupBy("part", "cell.mask", "good", "toxic").agg(F.sum("cell.n").alias("n"))


def _orders() -> Column:
    """The broadcast array of orders: 120 arrays of five filter bits."""
    return F.array(*[F.array(*[F.lit(_bit(f)) for f in order]) for order in ORDERS])


def _fold(cell: Column, orders: Column) -> Column:
    """600 structs of a cell: what each step of each order does to its documents."""
    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    start = F.struct(F.lit(0).alias("before"), F.array().cast(f"array<struct<{fields}>>").alias("steps"))

    def one(order: Column) -> Column:
        def step(state: Column, bit: Column) -> Column:
            fails = cell["mask"].bitwiseAND(bit) != 0
            gone = cell["mask"].bitwiseAND(state["before"]) != 0
            n = lambda cond: F.when(cond, cell["n"]).otherwise(F.lit(0).cast("long"))
            told = F.struct(
                n(~fails & ~gone).alias("kept"),
                n(fails & ~gone).alias("removed"),
                n(fails & gone).alias("redundant"),
                n(cell["mask"] == bit).alias("unique_fails"),
                n(fails & ~gone & (cell["good"] == 1)).alias("good_lost"),
                n(fails & ~gone & (cell["toxic"] == 1)).alias("toxic_lost"),
            )
            return F.struct(state["before"].bitwiseOR(bit).alias("before"), F.concat(state["steps"], F.array(told)).alias("steps"))

        return F.aggregate(order, start, step, lambda s: s["steps"])

    return F.flatten(F.transform(orders, one))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley: one row per part, order and step."""
    cells = masks(docs, labels)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # 128 at most
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(FILTERS))
    sums = F.aggregate("cells", zeros, lambda acc, cell: F.zip_with(acc, _fold(cell, _orders()), add))
    parts = stage(parts.select("part", sums.alias("sums")), "filter-sums")
    bits = F.flatten(_orders())
    # A filter's removed over all orders, whatever its step.
    at = lambda bit: F.aggregate(
        F.zip_with("sums", bits, lambda s, b: F.when(b == bit, s["removed"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    parts = parts.withColumn("shapley", F.array(*[at(_bit(f)) for f in FILTERS]))
    names = F.array(*[F.lit(o) for o in ORDERS])
    rows = parts.select("part", "shapley", F.posexplode("sums").alias("k", "sums"))
    rows = rows.select("part", "shapley", "sums", F.get(names, (F.col("k") / len(FILTERS)).cast("int")).alias("filter_order"), (F.col("k") % len(FILTERS) + 1).alias("step"))
    filter_ = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    return rows.select("part", "filter_order", "step", *[f"sums.{c}" for c in COUNTS], F.get("shapley", filter_ - 1).alias("shapley"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(ws) < {MIN_WORDS} THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_replace(d.t, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(d.t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(d.t, '{SYMBOLS}') THEN 8 ELSE 0 END)
         + (CASE WHEN d.doc_id > e.least THEN 16 ELSE 0 END) AS mask
  FROM d JOIN e ON d.t = e.t LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
         CAST(sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_audit", ORACLE)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
