"""Global sorts and limits for results that people read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def sort_rows(df: DataFrame, *keys: Column | str, unique: str | Sequence[str]) -> DataFrame:
    """Sort by ``keys`` and then by a column, or several, that tell all rows apart.

    Spark splits a sort into ranges of the key, and rows that compare equal share a
    task. With the unique column no two rows are equal, so a value that holds a third
    of the table is still cut into many ranges. It also makes the order repeatable.
    """
    return df.orderBy(*keys, *([unique] if isinstance(unique, str) else unique))


def top_rows(df: DataFrame, n: int, *keys: Column | str, unique: str | Sequence[str]) -> DataFrame:
    """First ``n`` rows by ``keys``: each task keeps ``n``, then one merge."""
    return sort_rows(df, *keys, unique=unique).limit(n)


def nulls_highest(key: str, *, descending: bool = False) -> Column:
    """Order in which NULL is above every value; Spark's own order puts it below."""
    return F.desc_nulls_first(key) if descending else F.asc_nulls_last(key)
