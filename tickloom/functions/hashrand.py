"""Random draws that depend only on (id, seed, stream).

A retried or re-planned task gets the same numbers, and any SQL engine with
``md5`` can recompute them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SCALE = float(2**32)


def _unit(digest: Column, start: int) -> Column:
    word = F.conv(F.substring(digest, start, 8), 16, 10).cast("double")
    return (word + F.lit(0.5)) / F.lit(_SCALE)


def _digest(row_id: Column, seed: int | Column, stream: str | Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    stream = stream if isinstance(stream, Column) else F.lit(stream)
    return F.md5(F.concat_ws(":", row_id.cast("string"), seed.cast("string"), stream.cast("string")))


def uniform(row_id: Column, seed: int | Column, stream: str | Column) -> Column:
    """A uniform draw in (0, 1)."""
    return _unit(_digest(row_id, seed, stream), 1)


def _box_muller(digest: Column) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(_unit(digest, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * _unit(digest, 9))


def normals(row_id: Column, seed: int, n: int) -> Column:
    """Array of ``n`` standard normals, streams 0..n-1.

    Box-Muller over two words of one digest. The digests are a first pass of their
    own, so each one is hashed once though it is read twice.
    """
    digests = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: _digest(row_id, seed, k))
    return F.transform(digests, _box_muller)


def order_key(row_id: Column, seed: int | Column) -> Column:
    """Hash whose order is a seeded shuffle of the ids."""
    return _digest(row_id, seed, "order")


#: Buckets that a hash order can be split into.
MOST_BUCKETS = 16**6


def order_bucket(key: Column, n: int) -> Column:
    """Split a hash order into ``n`` <= MOST_BUCKETS even buckets that follow the order."""
    word = F.conv(F.substring(key, 1, 6), 16, 10).cast("long")
    return F.floor(word * F.lit(n) / F.lit(MOST_BUCKETS)).cast("int")
