"""Queries by key, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that values print alike whichever engine produced them."""
    return df.select(
        *[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(build(spark, folder))
        ORACLES[name] = sql.strip()
        return build

    return register


def pct_sql(part: str, whole: str) -> str:
    """``100 * part / whole`` rounded half up to 2 places, exactly: doubles can miss a half."""
    return f"CAST((20000 * CAST({part} AS HUGEINT) + {whole}) // (2 * {whole}) AS DOUBLE) / 100"
