"""Checks a person runs before trusting a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from factsheet.functions.measures import row_count
from factsheet.functions.text import read_as


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def value_range(df: DataFrame, column: str, as_type: str) -> DataFrame:
    """Least and greatest value after the cast, so that numbers held as text compare as numbers."""
    value = read_as(column, as_type)
    return df.agg(F.min(value).alias(f"min_{column}"), F.max(value).alias(f"max_{column}"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null count per value; the NULL group shows 0."""
    return df.groupBy(column).agg(F.count(column).alias("n")).orderBy(column)


def value_domain(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Values present, and whether each is expected: shows a filter text that matches nothing."""
    return df.select(column).distinct().withColumn("expected", F.coalesce(F.col(column).isin(*expected), F.lit(False)))


def uncastable_rows(df: DataFrame, column: str, as_type: str) -> DataFrame:
    """Rows whose value is there but does not read as ``as_type``."""
    return df.filter(read_as(column, as_type).isNull() & F.col(column).isNotNull())


def blank_count(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.trim(column) == "").agg(row_count().alias("blank_count"))


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def duplicate_keys(df: DataFrame, *keys: str, more_than: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(row_count().alias("n")).filter(F.col("n") > more_than)


def negative_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0)


def column_types(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of each column, in one pass over the table."""
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(df.schema.fields)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"_{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))
