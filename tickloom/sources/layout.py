"""Tables stored by key, so that later joins and date ranges read what they need.

A table's rows go to buckets of their key and are sorted inside, and the buckets of two tables
with as many buckets meet without an exchange. A partition per year lets a range of dates skip
whole folders, and the order inside files lets it skip row groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir

#: Rows of a bucket of one year, in the mean; buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 4096


def buckets_for(df: DataFrame, date: str = "date") -> int:
    """Buckets that the largest year of ``df`` fills, as a power of two, so that tables of like size share them."""
    years = df.groupBy(F.year(date).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    most = years.agg(F.max("n")).first()[0] or 0
    return min(MOST_BUCKETS, 1 << max(0, int(most // BUCKET_ROWS)).bit_length())


def store(df: DataFrame, name: str, keys: list[str], buckets: int, date: str = "date", path: str | None = None) -> DataFrame:
    """Write ``df`` under ``path`` (the shared folder, if none is given) and register it as table ``name``.

    ``date`` is one of the keys. The table has a column ``year`` beside those of ``df``.
    """
    spark = df.sparkSession
    at = path or f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    by_year = df.withColumn("year", F.year(date))
    # One file per year and bucket: the rows of a bucket come from one task.
    dealt = by_year.repartition(buckets, *keys)
    dealt.write.partitionBy("year").bucketBy(buckets, *keys).sortBy(*keys).option("path", at).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def between(stored: DataFrame, first: str, last: str, date: str = "date") -> DataFrame:
    """Rows of a stored table from ``first`` to ``last`` (ISO dates, inclusive), by years, then row groups."""
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    return stored.where(F.col("year").between(int(first[:4]), int(last[:4])) & F.col(date).between(low, high))
