"""Small column helpers on window arrays and numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(col: Column | str) -> Column:
    """Round to six decimals as a double."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def finite(col: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def channel(flat: Column, index: int, n_channels: int = 3) -> Column:
    """One channel of a session-major flat window as an array."""
    return F.filter(flat, lambda _x, i: i % n_channels == index)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return total(arr) / F.size(arr)


def std_pop(arr: Column) -> Column:
    """Population standard deviation of an array, in two passes."""
    centre = F.array(mean(arr))
    squares = F.flatten(
        F.transform(centre, lambda m: F.transform(arr, lambda x: (x - m) * (x - m)))
    )
    return F.sqrt(mean(squares))


def tail(arr: Column, k: int) -> Column:
    return F.slice(arr, -k, k)


def absolute(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.abs(x))


def checksum(arr: Column) -> Column:
    """Position-weighted sum of an array; changes when values move."""
    weighted = F.transform(arr, lambda x, i: x * (i + 1))
    return total(weighted) / F.size(arr)
