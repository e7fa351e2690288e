"""Running figures over the ordered rows of a group that may be too large for one task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

# A group is hot when it has more rows than this and more than the table's share below.
HOT_ROWS = 1_000_000
# Fewer than this many groups can each have more than one part in as many of the rows, and so there are fewer
# than twice as many ranges, whatever the size of the table.
SHARE = 1024
# Sampled rows per range.
_SAMPLED = 64
_RANGE = "_range"


@dataclass(frozen=True)
class Running:
    """One running figure: ``fold`` of ``value`` over the rows up to each, where two parts meet by ``join``."""

    name: str
    value: Column
    fold: Callable[[Column], Column] = F.sum
    join: Callable[[Column, Column], Column] = lambda earlier, here: earlier + here


@dataclass(frozen=True)
class Ranges:
    """Bounds on ``order`` in the hot groups, by a hash of their keys. They are fixed numbers, so a task that runs again deals rows alike."""

    keys: tuple[str, ...]
    order: str
    bounds: DataFrame | None

    @property
    def hot(self) -> bool:
        return self.bounds is not None

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the number of bounds below a row's ``order``; NULL in groups that are not hot.

        A group whose key has the hash of a hot one is cut too, which changes no figure.
        """
        below = F.size(F.filter("_bounds", lambda b: b < F.col(self.order)))
        marked = df.withColumn("_mark", F.xxhash64(*self.keys)).join(F.broadcast(self.bounds), "_mark", "left")
        return marked.withColumn(_RANGE, F.when(F.col("_bounds").isNotNull(), below)).drop("_mark", "_bounds")


def ranges(df: DataFrame, keys: Sequence[str], order: str, *, share: int = SHARE, hot_rows: int = HOT_ROWS) -> Ranges:
    """Find the groups with more than ``hot_rows`` rows and one part in ``share`` of all, and bounds that cut them to such parts.

    One pass counts the most frequent keys in a sketch of fixed size. Only if there are hot ones does a second take
    a sample of their rows, from which the bounds come. Neither has a part in the result: a group that is missed,
    or bounds that lie unevenly, cost time only. Both passes run when this is called.
    """
    spark = df.sparkSession
    marked = df.select(F.xxhash64(*keys).alias("_mark"), F.col(order).alias("_order"))
    top = marked.agg(F.expr(f"approx_top_k(_mark, {share}, {max(10_000, 16 * share)})").alias("top"), F.count("*").alias("n")).first()
    least = max(float(hot_rows), top["n"] / share)
    hot = [r["item"] for r in top["top"] if r["count"] > least]
    if not hot:
        return Ranges(tuple(keys), order, None)
    rows = marked.filter(F.col("_mark").isin(hot) & F.col("_order").isNotNull())
    fraction = _SAMPLED / least
    sampled = rows.sample(fraction, seed=1) if fraction < 1 else rows
    values = defaultdict(list)
    for mark, value in sampled.orderBy("_mark", "_order").collect():
        values[mark].append(value)
    step = max(1, round(_SAMPLED if fraction < 1 else least))
    kind = StructType([StructField("_mark", LongType()), StructField("_bounds", ArrayType(marked.schema["_order"].dataType))])
    bounds = spark.createDataFrame([(m, v[step::step]) for m, v in values.items()], kind)
    return Ranges(tuple(keys), order, bounds)


def accumulate(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    figures: Sequence[Running],
    *,
    descending: bool = False,
    peers: bool = True,
    cut: Ranges | None = None,
    share: int = SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add each figure over the rows of a group from its first in ``order`` to the row itself.

    Rows of equal ``order`` share their figure if ``peers``; else each has its own, in any order among them. NULL keys
    form a group; NULL in ``order`` comes first, or last if ``descending``. A hot group is cut into ranges of ``order``, each
    a task's work, and what earlier ranges add up to is joined on: a table with fewer than twice ``share`` rows, so
    it is broadcast. The rows go through one shuffle. ``df`` is read for the ``ranges`` (or pass ``cut``), the rows,
    and once more for hot groups alone; it must give the same rows each time, so store one that does not.
    """
    cut = cut or ranges(df, keys, order, share=share, hot_rows=hot_rows)
    placed = cut.apply(df) if cut.hot else df
    # Nulls first or last by default, as the ranges are numbered.
    by = F.desc(order) if descending else F.asc(order)
    window = Window.partitionBy(*keys, *[_RANGE] * cut.hot).orderBy(by)
    window = (window.rangeBetween if peers else window.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumns({f.name: f.fold(f.value).over(window) for f in figures})
    if not cut.hot:
        return inside
    # A struct key compares NULL fields as equal.
    key = F.struct(*keys).alias("_group")
    totals = placed.filter(F.col(_RANGE).isNotNull()).groupBy(key, _RANGE).agg(*[f.fold(f.value).alias(f"_total_{f.name}") for f in figures])
    earlier = Window.partitionBy("_group").orderBy(F.desc(_RANGE) if descending else F.asc(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_group", _RANGE, *[f.fold(F.col(f"_total_{f.name}")).over(earlier).alias(f"_before_{f.name}") for f in figures])
    joined = inside.withColumn("_group", key).join(F.broadcast(before), ["_group", _RANGE], "left")
    whole = {f.name: F.coalesce(f.join(F.col(f"_before_{f.name}"), F.col(f.name)), f.name, f"_before_{f.name}") for f in figures}
    return joined.withColumns(whole).select(*inside.columns).drop(_RANGE)
