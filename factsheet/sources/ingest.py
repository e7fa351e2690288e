"""Readers. Text lands as text; ``operators.repair`` gives it types."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet table of a folder; with a ``schema``, planning reads no files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], *, multi_line: bool = False) -> DataFrame:
    """CSV with a header as all-text columns named by position.

    ``columns`` is fixed by the caller, so no pass over the data infers a schema. The
    quote is set, so a comma inside a quoted header or value does not split it.
    ``multi_line`` admits line breaks inside quotes but stops Spark from splitting files.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def snake_case(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_") or "column"


def with_clean_names(df: DataFrame) -> DataFrame:
    """Lower-case names without blanks, brackets or signs; a repeated name gets a number."""
    plain = [snake_case(c) for c in df.columns]
    names: list[str] = []
    for name in plain:
        choices = (name if n == 1 else f"{name}_{n}" for n in count(1))
        names.append(next(c for c in choices if c not in names and (c == name or c not in plain)))
    return df.toDF(*names)
