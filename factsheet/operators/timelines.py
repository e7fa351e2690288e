"""Series by entity and day, hours, gaps between events, and recency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factsheet.functions.dates import as_of_date, days_between, month_start
from factsheet.functions.measures import as_column, row_count
from factsheet.functions.text import matches_ignoring_case
from factsheet.operators.joins import lookup
from factsheet.operators.ranges import HOT_ROWS, SHARE, Running, accumulate
from factsheet.sources.publish import checkpointed


def of_entities(df: DataFrame, entities: Sequence[str] | None) -> DataFrame:
    return df if entities is None else df.filter(F.col("entity").isin(*entities))


def entity_ratio(part: DataFrame, whole: DataFrame, pattern: str) -> DataFrame:
    """Ratio of two series, day by day, for the entity whose name matches without regard to case.

    Both series hold ``entity``, ``day`` and ``value`` as text.
    """
    p = part.filter(matches_ignoring_case("entity", pattern)).select("entity", "day", F.col("value").try_cast("double").alias("part"))
    w = whole.select("entity", "day", F.col("value").try_cast("double").alias("whole"))
    return w.join(p, ["entity", "day"]).withColumn("ratio_pct", F.col("part") / F.nullif(F.col("whole"), F.lit(0)) * 100)


def entity_ratio_spread(part: DataFrame, whole: DataFrame, pattern: str) -> DataFrame:
    """The same ratio with the series joined on the entity alone.

    Each day of ``whole`` then meets every day of ``part``, which lists the square of the
    days. Per row of ``whole`` this gives the number of those pairs and the lowest, mean
    and highest ratio, which need only the count, bounds and mean of ``part``.
    """
    value = F.col("value").try_cast("double")
    named = matches_ignoring_case("entity", pattern)
    parts = (
        part.filter(named)
        .groupBy("entity")
        .agg(row_count().alias("pairs"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_mean"))
    )
    days = whole.filter(named).select("entity", "day", value.alias("whole"))
    # The number of days, with the value in use: Spark then runs the shuffles of ``whole`` once.
    sizes = days.groupBy("entity").agg(F.greatest(row_count(), F.count("whole")).alias("_days"))
    sized = parts.join(sizes, "entity")
    w = lookup(days, sized, "entity", "_days", how="inner")
    low, mean, high = (F.col(c) / F.nullif(F.col("whole"), F.lit(0)) * 100 for c in ("_lo", "_mean", "_hi"))
    # A negative denominator swaps the bounds.
    return w.select(
        "entity",
        "day",
        "whole",
        "pairs",
        F.least(low, high).alias("lowest_pct"),
        mean.alias("mean_pct"),
        F.greatest(low, high).alias("highest_pct"),
    )


def max_by_entity_day(df: DataFrame, as_type: str = "double", entities: Sequence[str] | None = None) -> DataFrame:
    """Highest value per entity and day, compared as numbers."""
    return of_entities(df, entities).groupBy("entity", "day").agg(F.max(F.col("value").try_cast(as_type)).alias("highest"))


def sum_by_entity_day(df: DataFrame, as_type: str = "double", entities: Sequence[str] | None = None) -> DataFrame:
    return of_entities(df, entities).groupBy("entity", "day").agg(F.sum(F.col("value").cast(as_type)).alias("total"))


def grand_total(df: DataFrame, as_type: str = "double", entities: Sequence[str] | None = None) -> DataFrame:
    return of_entities(df, entities).agg(F.sum(F.col("value").cast(as_type)).alias("total"))


def with_entity_total(
    part: DataFrame, whole: DataFrame, as_type: str = "double", entities: Sequence[str] | None = None
) -> DataFrame:
    """Two series joined by entity and day, with the entity's total of ``part`` on each row.

    The total has no order, so it is the same on all rows of an entity. It is grouped
    and joined back: a window would gather an entity in one task.
    """
    p = of_entities(part, entities).select("entity", "day", F.col("value").alias("part_value"))
    w = whole.select("entity", "day", F.col("value").alias("whole_value"))
    joined = p.join(w, ["entity", "day"])
    # The number of rows, with both series in use: Spark then runs the shuffles of the join once.
    rows = F.greatest(row_count(), F.count("whole_value"))
    totals = joined.groupBy("entity").agg(
        F.sum(F.col("part_value").cast(as_type)).alias("entity_total"), rows.alias("_rows")
    )
    return lookup(joined, totals, "entity", "_rows", how="inner").select("day", "whole_value", "entity", "part_value", "entity_total")


def running_total(
    df: DataFrame,
    value: str,
    name: str = "running_total",
    *,
    entity: str = "entity",
    day: str = "day",
    as_type: str = "double",
    share: int = SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the entity's total of ``value`` up to and with the row's day; rows of one day share it.

    Rows are summed per entity and day, and only those sums are ordered and stored, so one day may hold any part
    of the rows. An entity with a large part of the days is cut into ranges of them: sums inside, and the totals of
    earlier ranges on top. NULL values add nothing, a day with nothing else keeps the total before it (NULL, if
    there is none); rows without a day come first.
    """
    # A struct is never NULL and compares NULL fields as equal.
    keyed = df.withColumn("_key", F.struct(F.col(entity).alias("e"), F.col(day).alias("d")))
    sums = keyed.groupBy("_key").agg(F.sum(F.col(value).cast(as_type)).alias("_sum"), row_count().alias("_rows"))
    stored = checkpointed(sums).select("_key", "_sum", "_rows", "_key.e", "_key.d")
    totals = accumulate(stored, ["e"], "d", [Running(name, F.col("_sum"))], share=share, hot_rows=hot_rows)
    return lookup(keyed, totals.select("_key", "_rows", name), "_key", "_rows", how="inner").drop("_key")


def _hours_of_customers(df: DataFrame, min_history: int) -> DataFrame:
    """Busiest hours first, the earlier hour on ties, and the number of rows, per known customer.

    Rows are counted per customer and hour before anything is gathered, so an array
    holds at most 24 entries.
    """
    hour = F.hour("timestamp")
    per_hour = df.filter(F.col("customer_id").isNotNull()).groupBy("customer_id", hour.alias("_hour")).agg(row_count().alias("_n"))
    entry = F.when(F.col("_hour").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_hour").alias("h")))
    return (
        per_hour.groupBy("customer_id")
        .agg(F.sum("_n").alias("_rows"), F.array_sort(F.collect_list(entry)).alias("_ranked"))
        .filter(F.col("_rows") >= min_history)
        .select("customer_id", F.transform("_ranked", lambda x: x["h"]).alias("ranked_hours"), "_rows")
    )


def typical_hours(df: DataFrame, *, min_history: int = 5) -> DataFrame:
    """Hours of each customer with enough history, busiest first, the earlier hour on ties."""
    return _hours_of_customers(df, min_history).drop("_rows")


def unusual_hour_flag(df: DataFrame, *, min_history: int = 5, top: int = 3) -> DataFrame:
    """Whether each transaction falls in one of its customer's busiest hours."""
    typical = _hours_of_customers(df, min_history).select(
        "customer_id", F.slice("ranked_hours", 1, top).alias("_top"), "_rows"
    )
    hour = F.hour("timestamp")
    flag = (
        F.when(F.col("_top").isNull(), "insufficient_history")
        .when(F.coalesce(F.array_contains("_top", hour), F.lit(False)), "typical_hour")
        .otherwise("unusual_hour")
    )
    return lookup(df, typical, "customer_id", "_rows").select(
        "transaction_id", "customer_id", hour.cast("bigint").alias("txn_hour"), flag.alias("hour_flag")
    )


def days_since_last(df: DataFrame, name: str = "days_since_last_txn") -> DataFrame:
    """Days from a customer's previous transaction, ties in time taken by ``transaction_id``.

    The number is 0 for all but the first transaction of a customer's day, and that one
    counts from the customer's previous active day. So the ordered look-back runs over
    days, of which a customer has few, and a customer with a large part of all rows is
    never sorted in one task. ``transaction_id`` must be unique.
    """
    dated = df.withColumn("_key", F.struct("customer_id", F.col("timestamp").cast("date").alias("day")))
    moment = F.struct("timestamp", "transaction_id")
    by_day = Window.partitionBy("_key.customer_id").orderBy("_key.day")
    days = (
        dated.filter(F.col("timestamp").isNotNull())
        .groupBy("_key")
        .agg(F.min(moment).alias("_first"), row_count().alias("_rows"))
        .withColumn("_previous", F.lag("_key.day").over(by_day))
    )
    # A row without a time finds no day and gets NULL.
    gap = F.when(moment == F.col("_first"), days_between("_previous", "_key.day")).when(F.col("_first").isNotNull(), 0)
    return lookup(dated, days, "_key", "_rows").select(*df.columns, gap.cast("bigint").alias(name))


def recency_days(df: DataFrame, key: str, day: Column | str, as_of: str | Column | None = None) -> DataFrame:
    """Last active day per key and the days from it to ``as_of``, today unless given."""
    return (
        df.groupBy(key)
        .agg(F.max(as_column(day)).alias("last_active_date"))
        .withColumn("days_since_last_activity", days_between("last_active_date", as_of_date(as_of)).cast("bigint"))
    )


def active_months(df: DataFrame, key: str, day: Column | str) -> DataFrame:
    """Number of different calendar months with activity per key."""
    return df.groupBy(key).agg(F.count_distinct(month_start(day)).alias("active_months"))
