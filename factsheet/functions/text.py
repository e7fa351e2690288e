"""Repair of text columns: numbers held as text, separators, blanks, case."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from factsheet.functions.measures import MONEY, as_column


# What surrounds a number that a cast reads; what is no number of the kind at all costs an exception each.
_EDGE = r"[\x00-\x20\x7F]*"
_INTEGER = rf"^{_EDGE}[+-]?[0-9]+{_EDGE}$"


def read_as(value: Column | str, as_type: str) -> Column:
    """``try_cast`` of text, with the same NULLs, that hands only text which may be an integer to a cast to one.

    A failed cast to an integer costs an exception each; to a decimal it costs less than a pattern on every value.
    """
    value, kind = as_column(value), as_type.lower()
    if kind in ("int", "integer", "bigint", "long", "smallint", "short", "tinyint", "byte"):
        value = F.when(value.rlike(_INTEGER), value)
    return value.try_cast(as_type)


def clean_number(value: Column | str, as_type: str = MONEY, strip: str = ",% ") -> Column:
    """Drop separators and signs, then cast; what still fails is NULL."""
    return read_as(F.translate(as_column(value), strip, ""), as_type)


def blank_to_null(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(F.trim(value) == "", None).otherwise(value)


def normalized_key(value: Column | str) -> Column:
    """Join key that ignores case and outer blanks."""
    return F.upper(F.trim(as_column(value)))


def matches_ignoring_case(value: Column | str, pattern: str) -> Column:
    return as_column(value).ilike(pattern)


def trimmed_length(value: Column | str) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(as_column(value)))


def before_separator(value: Column | str, sep: str = ",") -> Column:
    """Text before the first ``sep``; NULL when there is none."""
    value = as_column(value)
    at = F.instr(value, sep)
    return F.when(at > 0, F.substr(value, F.lit(1), at - 1))


def through_next(value: Column | str, sep: str = ",") -> Column:
    """Text up to the character after the first ``sep``; without one, the first character."""
    value = as_column(value)
    return F.substr(value, F.lit(1), F.instr(value, sep) + 1)


def after_separator(value: Column | str, sep: str = ",", *, trim: bool = False) -> Column:
    """Text after the first ``sep``, its leading blank kept; the full text when there is none."""
    value = as_column(value)
    rest = F.substr(value, F.instr(value, sep) + 1, trimmed_length(value))
    return F.trim(rest) if trim else rest


def part_from_right(value: Column | str, n: int, sep: str = ".", limit: int = 4) -> Column:
    """The ``n``-th part counted from the right; NULL when absent, empty or over ``limit`` parts."""
    parts = F.split(as_column(value), re.escape(sep))
    return F.when(F.size(parts) <= limit, F.nullif(F.try_element_at(parts, F.lit(-n)), F.lit("")))


def ignoring_case(column: Column | str) -> Column:
    """Text that compares, groups, sorts and joins without case, and keeps its spelling."""
    return F.collate(as_column(column), "UTF8_LCASE")


def exact(column: Column | str) -> Column:
    """Text that compares byte by byte again."""
    return F.collate(as_column(column), "UTF8_BINARY")


def isin_ignoring_case(column: Column | str, values: Sequence[str]) -> Column:
    """Membership without case; NULL for NULL, false for no values."""
    return ignoring_case(column).isin(*[F.collate(F.lit(v), "UTF8_LCASE") for v in values])
