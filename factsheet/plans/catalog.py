"""All queries and their SQL checks."""

from __future__ import annotations

from factsheet.plans import lending, places, property, risk, rows, series  # noqa: F401  (they register themselves)
from factsheet.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
