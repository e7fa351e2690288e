"""Copies of a row: which come after the first, and which row is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from factsheet.operators.ranges import Running, accumulate


def number_in_group(df: DataFrame, keys: Sequence[str], order_by: str, name: str = "row_num", *, partitions: int | None = None) -> DataFrame:
    """``row_number`` per group for groups that may be too large for one task.

    ``order_by`` is a unique column; NULL keys form a group. The rows go through one shuffle, by their group; one
    with a large part of the table (one row in ``partitions``, if given) is cut into ranges of ``order_by`` and the
    rows in its earlier ranges are added. Numbers do not depend on where the ranges lie. Nothing is stored.
    """
    cut = {} if partitions is None else {"share": partitions, "hot_rows": 0}
    return accumulate(df, keys, order_by, [Running(name, F.lit(1).cast("bigint"))], peers=False, **cut)


def later_copies(df: DataFrame, keys: Sequence[str], order_by: str, name: str = "row_num") -> DataFrame:
    """Rows after the first of their group, with their number."""
    return number_in_group(df, keys, order_by, name).filter(F.col(name) > 1)


def first_copies(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """The first row of each group.

    Spark drops all but the first of each group in every task before the shuffle
    (``WindowGroupLimit``), so a hot group shrinks to one row per task.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))
    return df.withColumn("_n", first).filter(F.col("_n") == 1).drop("_n")
