"""Typed tables, stored results, views and exports.

Stored results go under the folder named by ``spark.checkpoint.dir``, which every
executor can read, so they outlive any executor. Spark deletes checkpoints that nothing
refers to; a result written to a path belongs to the caller, as with any written table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="factsheet-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder.

    Spark deletes the files when nothing refers to the result any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, *, view: str | None = None, path: str | None = None) -> DataFrame:
    """Compute a result once, so that later steps neither repeat nor lose it.

    With a ``path`` it is written there as Parquet, for the caller to keep or delete; else it is checkpointed.
    """
    if path:
        df.write.mode("overwrite").parquet(path)
        stored = df.sparkSession.read.schema(df.schema).parquet(path)
    else:
        stored = checkpointed(df)
    if view:
        stored.createOrReplaceTempView(view)
    return stored


def typed_table(df: DataFrame, schema: StructType, view: str | None = None, path: str | None = None) -> DataFrame:
    """Insert by position into a stored table of declared types: first column to first field, and so on.

    Casts are strict: a value that does not fit stops the insert, and later reads cast nothing.
    """
    return materialize(_by_position(df, schema), view=view, path=path)


def _by_position(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the names and types of ``schema``, first column to first field, by strict casts."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"{len(df.columns)} columns for {len(schema.fields)} fields")
    names = [f"_{i}" for i in range(len(schema.fields))]
    return df.toDF(*names).select(*[F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(names, schema.fields)])


BATCH = "_batch"


def append_typed(df: DataFrame, schema: StructType, batch: str, *, path: str | None = None, table: str | None = None) -> DataFrame:
    """Append by position to a table of declared types, as ``batch``, and return the whole table.

    The table is Parquet at ``path``, or ``table`` in the catalog; it is made if it is not there. Before anything is written
    the number of columns and their types by position are checked: each must cast to its field, and the fields
    of a table that is there must be those declared. Casts are strict, and a value that does not fit ends the write.
    A batch is one partition, which is replaced whole when the job commits: a batch that runs again, after a lost
    executor or a mistake, leaves its rows once, and a write that fails leaves the table as it was. An empty batch
    that was there before stays as it was, since it has no rows to replace it with. Batches that run at the
    same time must not be the same one.
    """
    spark = df.sparkSession
    if (path is None) == (table is None):
        raise ValueError("give a path or a table")
    if not batch or any(f.name.lower() == BATCH for f in schema.fields):
        raise ValueError(f"the batch needs a name, and {BATCH} is the column that holds it")
    try:
        rows = _by_position(df, schema).withColumn(BATCH, F.lit(batch))
    except AnalysisException as error:
        raise ValueError(f"a column cannot be cast to its field: {error}") from error
    stored = StructType([*[StructField(f.name, f.dataType) for f in schema.fields], StructField(BATCH, StringType())])

    def check(found: StructType) -> None:
        if [(f.name, f.dataType) for f in found.fields] != [(f.name, f.dataType) for f in stored.fields]:
            raise ValueError(f"the table has {found.simpleString()}, not {stored.simpleString()}")

    if table is not None:
        if spark.catalog.tableExists(table):
            check(spark.table(table).schema)
        else:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.fields)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY ({BATCH})")
        path = _location(spark, table)
    elif (found := _stored_schema(spark, path)) is not None:
        check(found)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)
    if table is not None:
        spark.catalog.recoverPartitions(table)
        spark.catalog.refreshTable(table)
        return spark.table(table).drop(BATCH)
    return spark.read.schema(stored).parquet(path).drop(BATCH)


def _location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]


def _stored_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema that the files have, with the batch as text whatever its names look like; None without files."""
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return StructType([*[f for f in found.fields if f.name != BATCH], StructField(BATCH, StringType())])


@dataclass(frozen=True)
class Expectation:
    """A condition that holds for a good row; NULL counts as not holding.

    ``refuse``: with more than ``most`` such rows nothing is published. Else they are put aside, and the rest is published.
    """

    name: str
    holds: Column
    refuse: bool = False
    most: int = 0


class Refused(ValueError):
    """A publish that an expectation stopped. ``failed`` has the rows that fail each, ``rows`` all rows."""

    def __init__(self, broken: Mapping[str, int], failed: Mapping[str, int], rows: int) -> None:
        super().__init__(f"rows that fail: {dict(broken)}, of {rows}")
        self.failed, self.rows = dict(failed), rows


@dataclass(frozen=True)
class Published:
    """A version that was written: where, how many rows, and how many of them fail each expectation."""

    spark: SparkSession = field(repr=False)
    path: str
    schema: StructType = field(repr=False)
    rows: int
    failed: Mapping[str, int]

    def _part(self, name: str) -> DataFrame:
        stored = StructType([*self.schema.fields, StructField("_part", StringType())])
        return self.spark.read.schema(stored).parquet(self.path).filter(F.col("_part") == name)

    def table(self) -> DataFrame:
        """The rows that are published."""
        return self._part("good").drop("_part")

    def set_aside(self) -> DataFrame:
        """The rows that failed an expectation which does not refuse."""
        return self._part("aside").drop("_part")

    def report(self) -> DataFrame:
        """One row per expectation: its name, the rows that fail it, and all rows."""
        lines = [(name, n, self.rows) for name, n in self.failed.items()]
        return self.spark.createDataFrame(lines, "expectation string, failed_rows bigint, total_rows bigint")


def checked_publish(df: DataFrame, expectations: Sequence[Expectation], folder: str, *, view: str | None = None) -> Published:
    """Write ``df`` as a new version under ``folder`` and count, in the same pass, the rows that fail each expectation.

    However many expectations there are, ``df`` is computed once: the counts are observed while rows are written. Every
    version has a folder of its own, so a refused one, which raises ``Refused``, touches nothing that is published, and
    ``view`` (a temporary name) is moved to the new version only after all counts are in. A row that fails an
    expectation with ``refuse`` and stays within its ``most`` is published; one that fails another is put aside.
    No rows fail nothing.
    """
    spark = df.sparkSession
    names = [e.name for e in expectations]
    if len(set(names)) < len(names):
        raise ValueError("expectations of the same name")
    path, seen = f"{folder.rstrip('/')}/{uuid.uuid4().hex}", Observation()
    fails = [~F.coalesce(e.holds, F.lit(False)) for e in expectations]
    aside = [f for f, e in zip(fails, expectations) if not e.refuse]
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(f, 1)).alias(f"failed_{i}") for i, f in enumerate(fails)])
    part = F.when(F.greatest(F.lit(False), F.lit(False), *aside), "aside").otherwise("good")
    counted.withColumn("_part", part).write.partitionBy("_part").parquet(path)
    found = seen.get
    failed = {name: found[f"failed_{i}"] for i, name in enumerate(names)}
    broken = {e.name: failed[e.name] for e in expectations if e.refuse and failed[e.name] > e.most}
    if broken:
        raise Refused(broken, failed, found["rows"])
    published = Published(spark, path, df.schema, found["rows"], failed)
    if view:
        published.table().createOrReplaceTempView(view)
    return published


def catalog_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table of the catalog over the Parquet files at ``path``, which stay where they are; one of the name is made anew if it lies elsewhere."""
    if spark.catalog.tableExists(name):
        if _location(spark, name).rstrip("/").removeprefix("file:") == path.rstrip("/").removeprefix("file:"):
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    spark.catalog.createTable(name, path=path, source="parquet")
    return spark.table(name)


def catalog_view(spark: SparkSession, name: str, sql: str) -> DataFrame:
    """A view of the catalog by its text, over tables of the catalog, replaced in one step if it is there.

    It is not bound to the session that made it, as a temporary one is: every session of the catalog reads it by its
    name, and it lasts as long as the catalog does. Spark refuses a text that names a temporary view.
    """
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {sql}")
    return spark.table(name)


def saved_view(df: DataFrame, name: str) -> DataFrame:
    """Name a query. Nothing is computed or stored."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def export(df: DataFrame, path: str, fmt: str = "parquet", *, one_file: bool = False, most_rows: int = 100_000) -> str:
    """Write for use elsewhere, one file per task, or one file if there are no more than ``most_rows`` rows."""
    if one_file and df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} rows for one file")
    out = df.coalesce(1) if one_file else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return path
