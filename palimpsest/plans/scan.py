"""Ordered scans of a snapshot (or of any frame with a key column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prefix_range


def _within(df: DataFrame, start, end, key: str) -> DataFrame:
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    return df if end is None else df.where(F.col(key) < F.lit(end))


def _ordered(df: DataFrame, ascending: bool, key: str) -> DataFrame:
    return df.orderBy(F.col(key).asc() if ascending else F.col(key).desc())


def full_scan(df: DataFrame, ascending: bool = True, *, key: str = "key") -> DataFrame:
    return _ordered(df, ascending, key)


def range_scan(df: DataFrame, start=None, end=None, ascending: bool = True, *, key: str = "key", ordered: bool = True) -> DataFrame:
    """Keys in [start, end); None leaves a side open. The bounds pass below resolve()'s window, as the key is what it partitions by."""
    if start is None and end is None:
        raise ValueError("a range needs a start or an end")
    if start is not None and end is not None and start > end:
        raise ValueError("the range's start is above its end")
    out = _within(df, start, end, key)
    return _ordered(out, ascending, key) if ordered else out


def prefix_scan(df: DataFrame, prefix, ascending: bool = True, *, key: str = "key", ordered: bool = True) -> DataFrame:
    start, end = prefix_range(prefix)
    out = _within(df, start, end, key)
    return _ordered(out, ascending, key) if ordered else out


def page(df: DataFrame, n: int, after=None, ascending: bool = True, *, key: str = "key") -> DataFrame:
    """The next n rows beyond the key `after`: a top-n, not a full sort."""
    if after is not None:
        df = df.where(F.col(key) > F.lit(after) if ascending else F.col(key) < F.lit(after))
    return _ordered(df, ascending, key).limit(n)


def first_key(df: DataFrame, *, key: str = "key") -> DataFrame:
    return page(df, 1, key=key)


def last_key(df: DataFrame, *, key: str = "key") -> DataFrame:
    return page(df, 1, ascending=False, key=key)


def first_at_or_after(df: DataFrame, at, *, key: str = "key") -> DataFrame:
    """Seek forwards."""
    return _ordered(df.where(F.col(key) >= F.lit(at)), True, key).limit(1)


def last_at_or_before(df: DataFrame, at, *, key: str = "key") -> DataFrame:
    """Seek backwards."""
    return _ordered(df.where(F.col(key) <= F.lit(at)), False, key).limit(1)
