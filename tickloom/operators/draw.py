"""The first rows of a seeded order, by a threshold instead of a sort.

The n-th smallest hash of a key is found by counting digits: rows are counted by the first digits
of their hash, which gives the digits that the n-th one has and how many come before; rows with
these digits are counted by the next ones; and of the few that share them all, the n-th is
picked. Rows up to that threshold are then a plain filter, so nothing but counts, and the few
candidates of the last step, is shuffled, and a draw of a tenth of a table moves no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashrand
from ..session import small

#: Hash digits counted in a pass: 65,536 counts a key at most, whatever its rows.
DIGITS = 4
PASSES = 2


def _nth(counts: DataFrame, by: list[str], rank: Column) -> DataFrame:
    """Per ``by``, the digits whose rows hold the ``rank``-th one (1-based) and the rank inside them."""
    listed = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("digits", "n"))).alias("counts"))
    start = F.struct(rank.cast("long").alias("left"), F.lit(None).cast("string").alias("digits"))

    def step(state: Column, c: Column) -> Column:
        here = state["digits"].isNull() & (state["left"] <= c["n"])
        going = state["digits"].isNull() & ~here
        return F.struct(
            F.when(going, state["left"] - c["n"]).otherwise(state["left"]).alias("left"),
            F.when(here, c["digits"]).otherwise(state["digits"]).alias("digits"),
        )

    return listed.select(*by, F.aggregate("counts", start, step).alias("at")).select(*by, "at.left", "at.digits")


def thresholds(rows: DataFrame, keys: list[str], row_id: str, wanted: Column) -> DataFrame:
    """(keys, __n, __cut): for each number in the array ``wanted``, the hash and id of that many-th row.

    ``rows`` holds the keys, ``row_id`` and ``__key``, the hash that orders them (ties by id). The
    numbers are the same for all rows of a key. ``__cut`` is null where the key has no more rows than
    the number, and a hash below all others for a number of zero or less.
    """
    counted = rows.groupBy(*keys, F.substring("__key", 1, DIGITS).alias("digits")).agg(F.count(F.lit(1)).alias("n"), F.max(wanted).alias("__wanted"))
    # One row per key and number; the sizes are those of the given numbers.
    numbers = counted.groupBy(*keys).agg(F.max("__wanted").alias("w"), F.sum("n").alias("__total"))
    numbers = numbers.select(*keys, "__total", F.explode(F.array_distinct("w")).alias("__n"))
    every = small(numbers, "draw-numbers")
    by = [*keys, "__n"]
    inside = every.where("__n > 0 AND __n < __total")
    found = small(_nth(counted.drop("__wanted").join(inside, keys), by, F.col("__n")), "draw-digits")
    for k in range(1, PASSES):
        near = _match(rows, keys, found, DIGITS * k)
        deeper = near.groupBy(*by, F.substring("__key", DIGITS * k + 1, DIGITS).alias("digits"), F.col("at").alias("before"), "left").agg(F.count(F.lit(1)).alias("n"))
        deeper = deeper.withColumn("digits", F.concat("before", "digits"))
        found = small(_nth(deeper, [*by, "left"], F.col("left")).toDF(*by, "outer", "left", "digits").drop("outer"), "draw-digits")
    near = _match(rows, keys, found, DIGITS * PASSES)
    few = near.groupBy(*by, "left").agg(F.sort_array(F.collect_list(F.struct(F.col("__key").alias("key"), F.col(row_id).alias("id")))).alias("few"))
    cuts = few.select(*by, F.get("few", (F.col("left") - 1).cast("int")).alias("__cut"))
    none = F.when(F.col("__n") <= 0, F.struct(F.lit("").alias("key"), F.lit(None).cast(rows.schema[row_id].dataType).alias("id")))
    return every.join(cuts, by, "left").select(*by, F.coalesce("__cut", none).alias("__cut"))


def _match(rows: DataFrame, keys: list[str], found: DataFrame, digits: int) -> DataFrame:
    """Rows whose first hash digits are those found for one of their key's numbers."""
    at = found.select(*keys, "__n", "left", F.col("digits").alias("at"))
    return rows.withColumn("at", F.substring("__key", 1, digits)).join(at, [*keys, "at"])


def first_rows(df: DataFrame, keys: list[str], row_id: str, seed: int | Column, wanted: Column) -> DataFrame:
    """Rows among the first of their key's seeded order: ``df`` and ``__n``, once for each number of
    ``wanted`` (an array) that takes them. Ids are unique inside a key; ``df`` is read several times."""
    keyed = df.withColumn("__key", hashrand.order_key(F.col(row_id), seed))
    if not keys:
        keyed, keys = keyed.withColumn("__all", F.lit(1)), ["__all"]
    cuts = small(thresholds(keyed.select(*keys, row_id, "__key", wanted.alias("__w")), keys, row_id, F.col("__w")), "draw-cuts")
    own = F.struct(F.col("__key").alias("key"), F.col(row_id).alias("id"))
    met = keyed.join(cuts, keys)
    return met.where(F.col("__cut").isNull() | (own <= F.col("__cut"))).select(*df.columns, "__n")
