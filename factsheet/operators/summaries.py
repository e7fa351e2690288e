"""Totals by place and genre, and the city summary built over a repeated key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsheet.functions.measures import MONEY, int_avg, map_categories
from factsheet.functions.text import clean_number, exact, ignoring_case, normalized_key, read_as
from factsheet.operators.joins import Measure, fanout_aggregate
from factsheet.operators.ordering import sort_rows

# The age that stands for each age group.
AGE_OF_GROUP = {
    "18-24": 21,
    "25-34": 29,
    "35-44": 39,
    "45-54": 49,
    "55+": 60,
}
PLACE = ("city", "country", "subregion")


def total_by(df: DataFrame, value: str, as_type: str, *keys: str, name: str = "total") -> DataFrame:
    """Sum per key of numbers held as text; text that is no number adds nothing."""
    return df.groupBy(*keys).agg(F.sum(read_as(value, as_type)).alias(name))


def group_ignoring_case(df: DataFrame, key: str, *measures: Column) -> DataFrame:
    """``measures`` per text without regard to case, under the group's first spelling in byte order (capitals first).

    NULL is a group of its own. The measures are combined before the shuffle, so a common text is no hot task.
    """
    groups = df.groupBy(ignoring_case(key).alias("_folded")).agg(F.min(exact(key)).alias(key), *measures)
    return groups.drop("_folded")


def listeners(streams: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows of the join on city per genre and age group."""
    return fanout_aggregate(streams, cities, "city", left_by=["genre"], right_by=["age_group"], rows="total_listeners")


def average_age(streams: DataFrame, cities: DataFrame, ages: dict[str, int] = AGE_OF_GROUP) -> DataFrame:
    """Truncated mean age per genre over the join on city; a group without an age adds nothing."""
    aged = cities.withColumn("_age", map_categories("age_group", ages))
    measure = Measure("avg_age_per_genre", "_age", "int_mean")
    return fanout_aggregate(streams, aged, "city", left_by=["genre"], right_measures=[measure], rows="_rows").drop("_rows")


def city_summary(cities: DataFrame, streams: DataFrame) -> DataFrame:
    """Six measures per city over the join on country, compared without case and outer blanks."""
    c = cities.select(
        *PLACE,
        normalized_key("country").alias("_country"),
        read_as("city_population_mil", MONEY).alias("_population"),
        clean_number("gdp_per_capita_usd").alias("_gdp"),
    )
    s = streams.select(
        normalized_key("country").alias("_country"),
        read_as("monthly_streams", "bigint").alias("_streams"),
        read_as("revenue_usd", MONEY).alias("_revenue"),
        clean_number("skip_rate", strip="%").alias("_skip"),
    )
    return fanout_aggregate(
        c,
        s,
        "_country",
        left_by=PLACE,
        left_measures=[
            Measure("city_population_mil", "_population", "max"),
            Measure("gdp_per_capita_usd", "_gdp", "max"),
        ],
        right_measures=[
            Measure("total_streams", "_streams", "sum"),
            Measure("total_revenue", "_revenue", "sum"),
            Measure("avg_skip_rate", "_skip", "mean"),
        ],
        rows="total_records",
    )


def wealth_and_streams(summary: DataFrame) -> DataFrame:
    """Ordered by revenue, which is not shown."""
    return sort_rows(summary, F.desc("total_revenue"), unique=PLACE).select("gdp_per_capita_usd", "total_streams", "city", "country")


def high_volume_low_revenue(summary: DataFrame, *, streams_over: int = 10000, revenue_under: int = 300000) -> DataFrame:
    return summary.filter((F.col("total_streams") > streams_over) & (F.col("total_revenue") < revenue_under)).select(
        "city", "total_streams", "total_revenue"
    )


def summary_averages(summary: DataFrame) -> DataFrame:
    return summary.agg(int_avg("total_streams").alias("avg_streams"), F.avg("city_population_mil").alias("avg_population_mil"))


def growth_opportunities(summary: DataFrame, status: str = "Growth Opportunity") -> DataFrame:
    """Cities with more people and fewer streams than the mean city."""
    means = summary.agg(
        F.struct(int_avg("total_streams").alias("streams"), F.avg("city_population_mil").alias("population"))
    ).scalar()
    found = (
        summary.filter((F.col("city_population_mil") > means["population"]) & (F.col("total_streams") < means["streams"]))
        .select(
            *PLACE,
            F.col("city_population_mil").alias("population_mil"),
            "total_streams",
            "total_revenue",
            "gdp_per_capita_usd",
            (means["streams"] - F.col("total_streams")).alias("streams_below_avg"),
            F.lit(status).alias("market_status"),
        )
    )
    return sort_rows(found, F.desc("population_mil"), unique=PLACE)
