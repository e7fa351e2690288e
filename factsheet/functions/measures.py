"""Counts, rates, ratios, buckets and weights as ``Column`` expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"
SCORE = "decimal(6,2)"
# Wide enough for any row count, narrow enough that a quotient of two keeps 14+ places.
_COUNT = "decimal(20,0)"


def as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def row_count() -> Column:
    return F.count(F.lit(1))


def flag_count(flag: Column | str) -> Column:
    """Rows on which ``flag`` is true; NULL counts as not true."""
    return F.count_if(as_column(flag))


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """``100 * part / whole`` as a decimal rounded half up; NULL when ``whole`` is 0."""
    scaled = part.cast(_COUNT) * F.lit(Decimal(100))
    return F.round(F.try_divide(scaled, whole.cast(_COUNT)), places)


def flag_rate(flag: Column | str, places: int = 2) -> Column:
    """Percentage of rows on which ``flag`` is true."""
    return percent(flag_count(flag), row_count(), places)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` to 18 places, for counts with ``part <= whole``."""
    return F.try_divide(part.cast(_COUNT), whole.cast(_COUNT)).cast("decimal(20,18)")


def mean(total: Column, n: Column) -> Column:
    """Decimal mean to 12 places; ``avg`` of a decimal stops four places after its scale."""
    return F.try_divide(total, n.cast(_COUNT))


def int_avg(value: Column | str) -> Column:
    """Mean of integers truncated to an integer, as integer ``AVG`` does on some hosts."""
    value = as_column(value)
    return int_quotient(F.sum(value), F.count(value))


def int_quotient(total: Column, n: Column) -> Column:
    """``total / n`` truncated, as a decimal: exact where ``div`` would wrap around; NULL when ``n`` is 0."""
    total, n = total.cast("decimal(38,0)"), F.nullif(n.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return ((total - total % n) / n).cast("decimal(38,0)")


def safe_ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole``, NULL when ``whole`` is 0."""
    return as_column(part) / F.nullif(as_column(whole), F.lit(0))


def bucketize(
    value: Column | str,
    *,
    below: Sequence[tuple[float, str]] = (),
    at_least: Sequence[tuple[float, str]] = (),
    otherwise: str,
    keep_null: bool = False,
) -> Column:
    """Label by the first bound that holds.

    ``below`` tests ``value < bound``, ``at_least`` tests ``value >= bound``; give one
    of them. NULL falls to ``otherwise`` unless ``keep_null``.
    """
    value = as_column(value)
    if bool(below) == bool(at_least):
        raise ValueError("give either below or at_least")
    pairs = [(value < b, label) for b, label in below] + [(value >= b, label) for b, label in at_least]
    if keep_null:
        pairs.insert(0, (value.isNull(), None))
    return reduce(lambda acc, p: acc.when(p[0], F.lit(p[1])), pairs[1:], F.when(pairs[0][0], F.lit(pairs[0][1]))).otherwise(otherwise)


def map_categories(value: Column | str, mapping: Mapping, *, keep_unmatched: bool = False) -> Column:
    """Replace listed values; an unlisted one gives NULL, or itself if ``keep_unmatched``."""
    value = as_column(value)
    (first, out), *rest = mapping.items()
    chain = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), rest, F.when(value == first, F.lit(out)))
    return chain.otherwise(value) if keep_unmatched else chain


def weighted_flags(rules: Sequence[tuple[Column, int]]) -> Column:
    """Sum of the weights whose condition holds."""
    return reduce(add, (F.when(cond, weight).otherwise(0) for cond, weight in rules))


def weighted_sum(weights: Mapping[str, str]) -> Column:
    """Weighted sum of score columns, a missing score counting 0, rounded once at the end.

    Weights are given as text so that they stay exact decimals.
    """
    zero = F.lit(0).cast(SCORE)
    return reduce(add, (F.coalesce(F.col(c), zero) * F.lit(Decimal(w)) for c, w in weights.items())).cast(SCORE)
