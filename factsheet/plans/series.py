"""Two series by region and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampNTZType

from factsheet.functions.measures import MONEY
from factsheet.operators import ordering, timelines
from factsheet.plans.registry import query
from factsheet.plans.tables import READINGS_SQL, deaths, doses, order_readings, read_table
from factsheet.sources.publish import Expectation, append_typed, catalog_table, catalog_view, checked_publish, fresh_path, saved_view, typed_table

ENTITIES = ["AFRICA", "ASIA", "EUROPE"]
IN_SQL = "entity IN ('AFRICA', 'ASIA', 'EUROPE')"
WIDE = "decimal(28,2)"


def _largest_first(df: DataFrame, measure: str) -> DataFrame:
    return ordering.sort_rows(df, F.desc(measure), unique=["entity", "day"])


@query(
    "entity_ratio",
    f"""WITH {READINGS_SQL}
SELECT entity, day, CAST(w.value AS DOUBLE) AS whole, CAST(p.value AS DOUBLE) AS part,
       CAST(p.value AS DOUBLE) / NULLIF(CAST(w.value AS DOUBLE), 0) * 100 AS ratio_pct
FROM doses p JOIN deaths w USING (entity, day) WHERE entity ILIKE 'africa'""",
)
def entity_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return timelines.entity_ratio(doses(spark, folder), deaths(spark, folder), "africa").orderBy("entity", "day")


@query(
    "entity_ratio_spread",
    f"""WITH {READINGS_SQL},
pairs AS (SELECT w.entity, w.day, CAST(w.value AS DOUBLE) AS whole, CAST(p.value AS DOUBLE) / NULLIF(CAST(w.value AS DOUBLE), 0) * 100 AS ratio
          FROM doses p JOIN deaths w ON p.entity = w.entity WHERE p.entity ILIKE 'africa')
SELECT entity, day, whole, COUNT(*) AS pairs, ROUND(MIN(ratio), 6) AS lowest_pct, ROUND(AVG(ratio), 6) AS mean_pct,
       ROUND(MAX(ratio), 6) AS highest_pct
FROM pairs GROUP BY entity, day, whole""",
)
def entity_ratio_spread(spark: SparkSession, folder: str) -> DataFrame:
    spread = timelines.entity_ratio_spread(doses(spark, folder), deaths(spark, folder), "africa")
    percents = {c: F.round(c, 6) for c in ("lowest_pct", "mean_pct", "highest_pct")}
    return spread.withColumns(percents).orderBy("entity", "day")


@query(
    "max_by_entity_day",
    f"WITH {READINGS_SQL} SELECT entity, day, CAST(MAX(value) AS DOUBLE) AS highest FROM order_readings GROUP BY entity, day",
)
def max_by_entity_day(spark: SparkSession, folder: str) -> DataFrame:
    return _largest_first(timelines.max_by_entity_day(order_readings(spark, folder)), "highest")


@query(
    "max_by_listed_entity_day",
    f"WITH {READINGS_SQL} SELECT entity, day, CAST(MAX(value) AS DOUBLE) AS highest FROM order_readings WHERE {IN_SQL} GROUP BY entity, day",
)
def max_by_listed_entity_day(spark: SparkSession, folder: str) -> DataFrame:
    return _largest_first(timelines.max_by_entity_day(order_readings(spark, folder), entities=ENTITIES), "highest")


@query(
    "sum_by_entity_day",
    f"WITH {READINGS_SQL} SELECT entity, day, CAST(SUM(value) AS DOUBLE) AS total FROM order_readings WHERE {IN_SQL} GROUP BY entity, day",
)
def sum_by_entity_day(spark: SparkSession, folder: str) -> DataFrame:
    return _largest_first(timelines.sum_by_entity_day(order_readings(spark, folder), MONEY, ENTITIES), "total")


@query("global_total", f"WITH {READINGS_SQL} SELECT CAST(SUM(value) AS DOUBLE) AS total FROM order_readings WHERE {IN_SQL}")
def global_total(spark: SparkSession, folder: str) -> DataFrame:
    return timelines.grand_total(order_readings(spark, folder), MONEY, ENTITIES)


@query(
    "join_two_keys",
    f"""WITH {READINGS_SQL}
SELECT entity, day, CAST(p.value AS DOUBLE) AS doses, CAST(w.value AS DOUBLE) AS deaths
FROM doses p JOIN deaths w USING (entity, day)""",
)
def join_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    p = doses(spark, folder).select("entity", "day", F.col("value").cast("double").alias("doses"))
    w = deaths(spark, folder).select("entity", "day", F.col("value").cast("double").alias("deaths"))
    return p.join(w, ["entity", "day"])


def _with_total(spark: SparkSession, folder: str) -> DataFrame:
    return timelines.with_entity_total(doses(spark, folder), deaths(spark, folder), WIDE, ENTITIES)


JOINED_SQL = f"""{READINGS_SQL},
joined AS (
  SELECT p.day, w.value AS whole_value, w.entity, p.value AS part_value, SUM(p.value) OVER (PARTITION BY w.entity) AS entity_total
  FROM doses p JOIN deaths w ON p.entity = w.entity AND p.day = w.day WHERE p.{IN_SQL})"""
TEXT_SQL = "CAST(whole_value AS VARCHAR) AS whole_value, entity, CAST(part_value AS VARCHAR) AS part_value, CAST(entity_total AS DOUBLE) AS entity_total"


@query("partition_total", f"WITH {JOINED_SQL} SELECT day, {TEXT_SQL} FROM joined")
def partition_total(spark: SparkSession, folder: str) -> DataFrame:
    return _with_total(spark, folder).orderBy("entity", "day")


@query(
    "running_total",
    f"""WITH {READINGS_SQL}
SELECT entity, day, CAST(value AS DOUBLE) AS value,
       CAST(SUM(CAST(value AS DECIMAL(28,2))) OVER (PARTITION BY entity ORDER BY day) AS DOUBLE) AS running_total
FROM order_readings""",
)
def running_total(spark: SparkSession, folder: str) -> DataFrame:
    readings = order_readings(spark, folder).select("entity", "day", F.col("value").cast(WIDE).alias("value"))
    return timelines.running_total(readings, "value", as_type=WIDE)


@query(
    "positional_rename",
    f"""WITH {JOINED_SQL}
SELECT day AS entity, CAST(whole_value AS VARCHAR) AS doses, entity AS day, CAST(part_value AS VARCHAR) AS deaths,
       CAST(entity_total AS DOUBLE) AS rolling_doses FROM joined""",
)
def positional_rename(spark: SparkSession, folder: str) -> DataFrame:
    """Names are given by position and so end on other columns than meant; kept as it is."""
    return _with_total(spark, folder).toDF("entity", "doses", "day", "deaths", "rolling_doses")


@query(
    "typed_table",
    f"""WITH {JOINED_SQL}
SELECT entity, CAST(day AS TIMESTAMP) AS day, CAST(whole_value AS DOUBLE) AS deaths, CAST(part_value AS DOUBLE) AS doses,
       CAST(entity_total AS DOUBLE) AS rolling_doses FROM joined""",
)
def typed(spark: SparkSession, folder: str) -> DataFrame:
    schema = StructType(
        [
            StructField("entity", StringType()),
            StructField("day", TimestampNTZType()),
            StructField("deaths", DoubleType()),
            StructField("doses", DoubleType()),
            StructField("rolling_doses", DoubleType()),
        ]
    )
    rows = _with_total(spark, folder).select("entity", "day", "whole_value", "part_value", "entity_total")
    return typed_table(rows, schema, view="vaccinated_people")


@query(
    "append_typed",
    f"""WITH {READINGS_SQL}
SELECT entity, CAST(day AS TIMESTAMP) AS day, CAST(value AS DOUBLE) AS doses FROM order_readings WHERE day < DATE '1995-01-01'
UNION ALL
SELECT entity, CAST(day AS TIMESTAMP), CAST(value AS DOUBLE) FROM order_readings WHERE day >= DATE '1995-01-01'""",
)
def appended(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches into one table, and the first of them again."""
    schema = StructType([StructField("entity", StringType()), StructField("day", TimestampNTZType()), StructField("doses", DoubleType())])
    readings = order_readings(spark, folder)
    early, late = (readings.filter(F.col("day") < "1995-01-01"), readings.filter(F.col("day") >= "1995-01-01"))
    path = fresh_path(spark, "readings")
    append_typed(early, schema, "early", path=path)
    append_typed(late, schema, "late", path=path)
    return append_typed(early, schema, "early", path=path)


@query(
    "checked_publish",
    """WITH failing AS (
  SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE l_quantity > 49) AS many, COUNT(*) FILTER (WHERE l_discount < 0) AS negative,
         COUNT(*) FILTER (WHERE l_shipdate < DATE '1993-01-01') AS early, COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS flag FROM lineitem)
SELECT unnest(['few pieces', 'no negative discount', 'shipped since 1993', 'known flag']) AS expectation,
       unnest([many, negative, early, flag]) AS failed_rows, total_rows FROM failing""",
)
def checked(spark: SparkSession, folder: str) -> DataFrame:
    expectations = [
        Expectation("few pieces", F.col("l_quantity") <= 49),
        Expectation("no negative discount", F.col("l_discount") >= 0, refuse=True),
        Expectation("shipped since 1993", F.col("l_shipdate") >= F.lit("1993-01-01").cast("timestamp_ntz")),
        Expectation("known flag", F.col("l_returnflag").isin("A", "N")),
    ]
    return checked_publish(read_table(spark, folder, "lineitem"), expectations, fresh_path(spark, "lines")).report()


@query(
    "catalog_view",
    """SELECT r_name AS entity, COUNT(*) AS nations, MIN(n_name) AS first_nation FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def durable_view(spark: SparkSession, folder: str) -> DataFrame:
    for name in ("nation", "region"):
        catalog_table(spark, f"factsheet_{name}", f"{folder}/{name}.parquet")
    return catalog_view(
        spark,
        "factsheet_nations",
        """SELECT r_name AS entity, COUNT(*) AS nations, MIN(n_name) AS first_nation
           FROM factsheet_nation JOIN factsheet_region ON n_regionkey = r_regionkey GROUP BY r_name""",
    )


@query("saved_view", f"WITH {JOINED_SQL} SELECT day, {TEXT_SQL} FROM joined")
def view(spark: SparkSession, folder: str) -> DataFrame:
    return saved_view(_with_total(spark, folder), "vaccinated_people_view")


@query(
    "sort_ordinal",
    f"WITH {READINGS_SQL} SELECT entity, day, CAST(value AS DOUBLE) AS doses FROM doses ORDER BY doses DESC, entity, day",
)
def sort_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """The third column, largest first, by name rather than by position."""
    series = doses(spark, folder).select("entity", "day", F.col("value").cast("double").alias("doses"))
    return _largest_first(series, "doses")
