"""Joins that keep their multiplicity without building every pair."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factsheet.functions.measures import int_quotient, row_count
from factsheet.functions.text import ignoring_case, normalized_key


def join_on_normalized(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Equi join on keys compared without case and outer blanks; both sides keep their columns."""
    l = left.withColumn("_key", normalized_key(left_key))
    r = right.withColumn("_key", normalized_key(right_key))
    return l.join(r, "_key").drop("_key")


# A key is hot when it has more rows than this and more than the table's share below.
_HOT_ROWS = 1_000_000
# At most this many keys can each have more than one part in as many of the rows, so the
# hot side of a look-up never has more rows, whatever the size of the table.
_MAX_HOT_KEYS = 100_000


def lookup(
    df: DataFrame, per_key: DataFrame, key: str, rows: str, *, how: str = "left", hot_rows: int = _HOT_ROWS
) -> DataFrame:
    """Join each row to the one row of its key, however unevenly the rows fall on the keys.

    ``rows`` is a column of ``per_key`` with the number of rows of ``df`` that have the
    key; it is not part of the result. Spark splits a skewed join only when both sides come
    straight from a shuffle, which an aggregate does not. So hot keys, whose number is
    bounded, are found in a broadcast, and their rows, like rows without a key, go through
    the shuffle spread by the partition they come from. That number is the same when a lost
    task is run again, so no row moves twice. ``df`` is evaluated once.

    Without hot keys the broadcast is empty and Spark drops it while running.
    """
    payload = [c for c in per_key.columns if c not in (key, rows)]
    # The same filter and columns wherever ``per_key`` is used: Spark then runs its shuffles
    # once, where it would read the source again for a version with fewer columns.
    per_key = per_key.filter(F.col(key).isNotNull())
    kept = [F.count(c).alias(f"n_{i}") for i, c in enumerate(payload)]
    total = per_key.agg(F.struct(F.sum(rows).alias("rows"), *kept)).scalar()["rows"]
    is_hot = F.col(rows) > F.greatest(F.lit(float(hot_rows)), total / _MAX_HOT_KEYS)
    values = F.struct(*payload)
    hot = F.broadcast(per_key.filter(is_hot).select(key, values.alias("_hot")))
    # Always 0, but not a constant: Spark would take a constant out of the join key.
    home = F.least(F.col(rows), F.lit(0)).cast("int")
    rest = per_key.select(key, home.alias("_place"), values.alias("_rest"))

    spread = F.col("_hot").isNotNull() | F.col(key).isNull()
    placed = df.join(hot, key, "left").withColumn("_place", F.when(spread, F.spark_partition_id() + 1).otherwise(0))
    found = placed.join(rest, [key, "_place"], "left").withColumn("_found", F.coalesce("_hot", "_rest"))
    if how == "inner":
        found = found.filter(F.col("_found").isNotNull())
    return found.select(*df.columns, *[F.col(f"_found.{c}").alias(c) for c in payload])


# A product of two row counts outgrows a bigint long before a cluster runs out of rows.
_ROWS = "decimal(20,0)"


@dataclass(frozen=True)
class Measure:
    """One output of ``fanout_aggregate``: ``how`` of ``column`` taken over the joined rows."""

    name: str
    column: str
    how: str  # sum, max, mean or int_mean

    def partials(self, prefix: str) -> list[Column]:
        value = F.col(self.column)
        if self.how == "max":
            return [F.max(value).alias(f"{prefix}_max")]
        return [F.sum(value).alias(f"{prefix}_sum"), F.count(value).alias(f"{prefix}_n")]

    def final(self, prefix: str, other_rows: str) -> Column:
        if self.how == "max":
            return F.max(f"{prefix}_max").alias(self.name)
        total = F.sum(F.col(f"{prefix}_sum") * F.col(other_rows).cast(_ROWS))
        n = F.sum(F.col(f"{prefix}_n").cast(_ROWS) * F.col(other_rows).cast(_ROWS))
        if self.how == "sum":
            return total.alias(self.name)
        if self.how == "mean":
            return F.try_divide(total, n).alias(self.name)
        if self.how == "int_mean":
            return int_quotient(total, n).alias(self.name)
        raise ValueError(f"unknown measure {self.how}")


# Groups of one side that meet in a task.
_BLOCK = 1000


def in_blocks(left: DataFrame, right: DataFrame, on: str, left_by: Sequence[str], right_by: Sequence[str], *, block: int = _BLOCK) -> DataFrame:
    """Inner join of two reduced sides, one row per (key, group) on each, however many groups a key has on both.

    Spark does not split a join of aggregates, so one key's pairs would be one task's work. Here the groups of a key are
    counted on both sides. One with more than ``block`` by ``block`` pairs is laid out as a grid: a left row goes to one line of
    it, by a hash of its group, and to all columns, a right row the other way round, and each cell is joined by
    itself. So every pair meets once, and a row is repeated once per ``block`` groups of the other side. There are at most as
    many grids as the pairs to make fill cells; Spark broadcasts them if they are few, and need not, as a key has
    one and its reduced rows are not many. Keys without pairs, NULL among them, are left out.
    """

    def groups(df: DataFrame, name: str) -> DataFrame:
        # With all columns in use: Spark then runs the shuffle under it once.
        used = F.greatest(row_count(), *[F.count(c) for c in df.columns if c != on])
        return df.filter(F.col(on).isNotNull()).groupBy(on).agg(used.alias(name))

    counted = groups(left, "_lefts").join(groups(right, "_rights"), on)
    pairs = F.col("_lefts").cast("double") * F.col("_rights")
    lines, columns = (F.ceil(F.col(n) / block).cast("int") for n in ("_lefts", "_rights"))
    grid = counted.filter(pairs > float(block) * block).select(on, lines.alias("_lines"), columns.alias("_columns"))

    def dealt(df: DataFrame, by: Sequence[str], own: str, other: str) -> DataFrame:
        placed = df.filter(F.col(on).isNotNull()).join(grid, on, "left")
        size, copies = F.coalesce(f"{own}s", F.lit(1)), F.coalesce(f"{other}s", F.lit(1))
        at = F.pmod(F.xxhash64(*by), size).cast("int")
        return placed.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), copies - 1))).drop("_lines", "_columns")

    l, r = dealt(left, left_by, "_line", "_column"), dealt(right, right_by, "_column", "_line")
    return l.join(r, [on, "_line", "_column"]).drop("_line", "_column")


def fanout_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: str,
    *,
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
    left_measures: Sequence[Measure] = (),
    right_measures: Sequence[Measure] = (),
    rows: str = "n",
    block: int = _BLOCK,
) -> DataFrame:
    """Group the join of two tables whose key repeats on both sides, without that join.

    Each side is first reduced to one row per (key, group). A pair of reduced rows then
    stands for the product of their row counts: counts multiply, a sum is taken as often
    as the other side has rows, a maximum is unchanged and a mean divides the two.
    The result equals that of grouping the full join; counts and integer sums come out
    as decimals of 38 digits.

    A key with many groups on both sides still has many pairs of them. ``in_blocks`` deals its rows out, so that
    no task makes more than ``block`` groups by ``block``.
    """

    def reduce_side(df: DataFrame, by: Sequence[str], measures: Sequence[Measure], side: str) -> DataFrame:
        partials = [p for i, m in enumerate(measures) for p in m.partials(f"_{side}{i}")]
        return df.groupBy(on, *by).agg(row_count().alias(f"_{side}_rows"), *partials)

    l, r = reduce_side(left, left_by, left_measures, "l"), reduce_side(right, right_by, right_measures, "r")
    pairs = in_blocks(l, r, on, left_by, right_by, block=block) if left_by and right_by else l.join(r, on)
    return pairs.groupBy(*left_by, *right_by).agg(
        F.sum(F.col("_l_rows").cast(_ROWS) * F.col("_r_rows").cast(_ROWS)).alias(rows),
        *[m.final(f"_l{i}", "_r_rows") for i, m in enumerate(left_measures)],
        *[m.final(f"_r{i}", "_l_rows") for i, m in enumerate(right_measures)],
    )


def join_ignoring_case(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi join on text compared without case; both sides keep their columns and their own spelling."""
    return left.join(right, ignoring_case(left[left_key]) == ignoring_case(right[right_key]), how)


def absent_everywhere(base: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """Rows of ``base`` whose key is in none of the sources.

    The keys of all sources are made distinct together, combined before the shuffle, so
    there is one anti join however many sources there are and however often a key repeats.
    """
    seen = reduce(DataFrame.union, [s.select(key) for s in sources]).distinct()
    return base.join(seen, key, "left_anti")


@dataclass(frozen=True)
class Tagged:
    """Rows of several sources in one DataFrame: the key, ``source`` (a name, or NULL for rows of none) and ``amount``.

    For sources that are parts of one table, which is then read once.
    """

    rows: DataFrame
    names: tuple[str, ...]

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)


def source_totals(key: str, sources: Mapping[str, DataFrame] | Tagged) -> DataFrame:
    """Total per key of each source, side by side, NULL where the key is not in the source.

    ``sources`` maps a name to a DataFrame of the key and an ``amount``, or has them ``Tagged``. All are stacked
    and grouped once: one shuffle of partial sums instead of one per source and a join
    for each. ``has_<name>`` tells a source without rows from one whose total is NULL.
    """

    def stacked(name: str, df: DataFrame) -> DataFrame:
        amount_type = df.schema["amount"].dataType
        return df.select(
            key,
            *[(F.col("amount") if n == name else F.lit(None).cast(amount_type)).alias(f"total_{n}") for n in sources],
            *[F.lit(n == name).alias(f"has_{n}") for n in sources],
        )

    if isinstance(sources, Tagged):
        rows = sources.rows.filter(F.col("source").isNotNull()).select(
            key,
            *[F.when(F.col("source") == n, F.col("amount")).alias(f"total_{n}") for n in sources],
            *[(F.col("source") == n).alias(f"has_{n}") for n in sources],
        )
    else:
        rows = reduce(DataFrame.unionByName, [stacked(n, df) for n, df in sources.items()])
    return rows.groupBy(key).agg(
        *[F.sum(f"total_{n}").alias(f"total_{n}") for n in sources],
        *[F.max(f"has_{n}").alias(f"has_{n}") for n in sources],
    )


def combine_sources(base: DataFrame, key: str, sources: Mapping[str, DataFrame] | Tagged) -> DataFrame:
    """``base`` with the total of each source, its presence, and ``sources_present``."""
    joined = base.join(source_totals(key, sources), key, "left")
    present = {f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in sources}
    count = reduce(lambda a, b: a + b, [F.col(f"has_{n}").cast("int") for n in sources])
    return joined.withColumns(present).withColumn("sources_present", count)
