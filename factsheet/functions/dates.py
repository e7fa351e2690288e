"""Dates held as text, day counts and months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from factsheet.functions.measures import as_column


def parse_day_first(value: Column | str, patterns: Sequence[str] = ("d/M/yyyy",)) -> Column:
    """First pattern that reads the text wins; none gives NULL."""
    value = as_column(value)
    return F.coalesce(*[F.try_to_date(value, p) for p in patterns])


def days_between(start: Column | str, end: Column | str) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(as_column(end), as_column(start))


def as_of_date(as_of: str | Column | None) -> Column:
    """The reference day: a given date, or today."""
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def month_start(value: Column | str) -> Column:
    """First day of the month: distinct like ``yyyy-MM`` text, but compared as an integer."""
    return F.trunc(as_column(value), "month")
