"""What several operators share: cut lineage, and join rows to keys that may be hot."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A word is a run of anything but the six ASCII white-space characters; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
_BATCH_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null. A lone surrogate, which Parquet cannot hold, becomes ``?``."""
    return (text or "").encode("utf-8", "replace").split()


def ship(spark: SparkSession) -> None:
    """Give this package to Python on the executors, once a session, as ``--py-files`` would.

    Rows with texts travel in batches of ``_BATCH_BYTES`` too, where the session does not ask for smaller ones.
    """
    context = spark.sparkContext
    if getattr(context, "_shipped_factsheet", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="llm-"))) / "factsheet_modules.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's own default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * _BATCH_BYTES))
    context._shipped_factsheet = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(folder)
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_join(df: DataFrame, per_key: DataFrame, key: str, by: Sequence[str | Column], copies: int = 32) -> DataFrame:
    """Left join each row to the one row of its key.

    The rows of a key go to ``copies`` tasks by a hash of the columns ``by``, and the key's one
    row goes to each of them, so a hot key never meets in one task. A null key finds nothing.
    """
    many = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(copies)).cast("int"))
    return salted.join(many, [key, "_salt"], "left").drop("_salt")


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns of these names, whatever their case, under other ones; and what selects its columns as they were."""
    taken = {n.lower() for n in names}
    moved = {c: f"aside_{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns]


def map_text(df: DataFrame, added: str, compute: Callable[[list[str | None]], list], keep: Sequence[str] | None = None, column: str = "text") -> DataFrame:
    """``keep`` (all columns by default) and the columns ``added`` (DDL) that ``compute`` makes of a batch of texts.

    An added column replaces one of its name. Rows stay where they are: no shuffle. A batch has texts of about
    ``_BATCH_BYTES``, or one that is longer, so what a task holds does not depend on how long texts are.
    """
    new = StructType.fromDDL(added)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept if c != column], F.col(f"`{column}`"))
    order = [c for c in source.columns if c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // _BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for batch in (whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])):
                made = compute(batch.column(column).to_pylist())
                arrays = [pa.array(x, type=to_arrow_type(f.dataType)) for x, f in zip(made, new)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in order], *arrays], names=[*order, *new.names])
                del batch, made, arrays
                pa.default_memory_pool().release_unused()  # idle workers stay, and would hold it

    return source.mapInArrow(run, StructType([*[f for f in source.schema if f.name in kept], *new]))
