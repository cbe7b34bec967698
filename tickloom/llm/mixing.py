"""Mix sources to target weights by repeating whole documents.

Sizes are summed by source, targets follow from the weights and a cap of two epochs, and a
document is emitted floor(rate) times plus once more if its hash draw falls under the fraction,
rate being its source's target over its source's size. Draws depend on the id, the source and
the size only, so reruns and retries agree, and a document never exceeds ceil(rate) <= 2 copies.

The targets solve target = min(cap, level * weight) with the shares' sum given: the same end
that sharing each excess again by weight comes to. Sources are ordered by the level at which
they meet their cap; running sums over that order give the level. That table has one row per
source and is the only one that a single task orders.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; empty
documents and sources get nothing; a null doc_id draws as an empty id, and repeated rows draw
alike; texts of any length are counted whole; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stage
from .common import WORD, query, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SALT = "mix-1"
_DIGITS = 13  # hex digits of an md5 that a double holds exactly


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the words of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size and target, one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    out = by_source.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), place).cast("double").alias("weight"))
    cap = F.col("source_size") * F.lit(float(epochs))
    out = out.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    out = out.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level if this source and all later ones stay under their caps: right at the first that it
    # fits, and smaller at each one after.
    out = out.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(1e300)) * F.col("weight"))
    return out.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, source: Column, size: Column, salt: str = SALT) -> Column:
    """Uniform in [0, 1) from an md5 of the row, which SQL can compute too."""
    parts = (F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")), size.cast("string"))
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def with_copies(docs_sized: DataFrame, salt: str = SALT) -> DataFrame:
    """Adds source_size, target and copies to rows of (doc_id, source, size)."""
    goal = targets(docs_sized).withColumnRenamed("source", "__source")
    out = docs_sized.join(goal, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    more = (draw(F.col("doc_id"), F.col("source"), F.col("size"), salt) < rate - whole).cast("long")
    return out.withColumn("copies", F.when(F.col("size") > 0, whole + more).otherwise(F.lit(0)).cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, with documents' columns."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    goal = targets(stage(sized(docs), "sizes")).select(F.col("source").alias("__source"), "source_size", "target")
    goal = goal.select("__source", F.struct("source_size", "target").alias("__goal"))
    out = docs.join(goal, F.col("source").cast("string").eqNullSafe(F.col("__source")))
    rate = F.when(F.col("__goal.source_size") > 0, F.col("__goal.target") / F.col("__goal.source_size")).otherwise(F.lit(0.0))
    more = (draw(F.col("doc_id").cast("long"), F.col("source").cast("string"), size) < rate - F.floor(rate)).cast("long")
    copies = F.when(size > 0, F.floor(rate) + more).otherwise(F.lit(0))
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return out.select(*docs.columns)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(list_extract({list(WEIGHTS)}, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)) AS DOUBLE) AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, {EPOCHS}.0::DOUBLE * source_size AS cap, {EPOCHS}.0::DOUBLE * source_size / weight AS full_at FROM s
), l AS (
  SELECT *, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM c)
             - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / ((SELECT sum(weight) FROM c)
             - coalesce(sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM c
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT coalesce(max(level), 1e300) FROM l WHERE level <= full_at)) AS target FROM c
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5(concat_ws('|', '{SALT}', coalesce(CAST(d.doc_id AS VARCHAR), ''), coalesce(d.source, ''), CAST(d.size AS VARCHAR))), 1, {_DIGITS}) AS BIGINT)
           / {16**_DIGITS}.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken
FROM r
"""


@query("op7_mix_weights", ORACLE)
def op7_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_copies(stage(sized(table(spark, sf_dir, "documents")), "sizes"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
