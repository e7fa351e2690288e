"""Streams, revenue and people by place and genre."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factsheet.functions.measures import MONEY, map_categories, row_count
from factsheet.functions.text import ignoring_case, isin_ignoring_case
from factsheet.operators import ordering, summaries
from factsheet.operators.joins import join_ignoring_case, join_on_normalized
from factsheet.plans.registry import query
from factsheet.plans.tables import MUSIC_SQL, cities, read_table, streams
from factsheet.sources.publish import materialize

PLACE_SQL = "city, country, subregion"


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.city_summary(cities(spark, folder), streams(spark, folder))


@query(
    "sum_try_cast",
    f"WITH {MUSIC_SQL} SELECT {PLACE_SQL}, CAST(SUM(TRY_CAST(monthly_streams AS BIGINT)) AS BIGINT) AS total_monthly_streams FROM streams GROUP BY ALL",
)
def sum_try_cast(spark: SparkSession, folder: str) -> DataFrame:
    totals = summaries.total_by(streams(spark, folder), "monthly_streams", "bigint", *summaries.PLACE, name="total_monthly_streams")
    return ordering.sort_rows(totals, F.desc("total_monthly_streams"), unique=summaries.PLACE)


@query(
    "total_by_keys",
    f"WITH {MUSIC_SQL} SELECT {PLACE_SQL}, CAST(SUM(TRY_CAST(city_population_mil AS DECIMAL(18,2))) AS DOUBLE) AS total_city_population_mil FROM cities GROUP BY ALL",
)
def total_by_keys(spark: SparkSession, folder: str) -> DataFrame:
    totals = summaries.total_by(cities(spark, folder), "city_population_mil", MONEY, *summaries.PLACE, name="total_city_population_mil")
    return ordering.sort_rows(totals, F.desc("total_city_population_mil"), unique=summaries.PLACE)


@query(
    "revenue_by_place",
    f"WITH {MUSIC_SQL} SELECT {PLACE_SQL}, CAST(SUM(TRY_CAST(revenue_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_monthly_revenue_usd FROM streams GROUP BY ALL",
)
def revenue_by_place(spark: SparkSession, folder: str) -> DataFrame:
    totals = summaries.total_by(streams(spark, folder), "revenue_usd", MONEY, *summaries.PLACE, name="total_monthly_revenue_usd")
    return ordering.sort_rows(totals, F.desc("total_monthly_revenue_usd"), unique=summaries.PLACE)


@query(
    "total_by_key",
    f"WITH {MUSIC_SQL} SELECT genre, CAST(SUM(TRY_CAST(monthly_streams AS BIGINT)) AS BIGINT) AS total_streams FROM streams GROUP BY genre",
)
def total_by_key(spark: SparkSession, folder: str) -> DataFrame:
    totals = summaries.total_by(streams(spark, folder), "monthly_streams", "bigint", "genre", name="total_streams")
    return totals.orderBy(F.desc("total_streams"))


@query(
    "revenue_by_genre",
    f"WITH {MUSIC_SQL} SELECT genre, CAST(SUM(TRY_CAST(revenue_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_genre_revenue FROM streams GROUP BY genre",
)
def revenue_by_genre(spark: SparkSession, folder: str) -> DataFrame:
    totals = summaries.total_by(streams(spark, folder), "revenue_usd", MONEY, "genre", name="total_genre_revenue")
    return totals.orderBy(F.desc("total_genre_revenue"))


@query(
    "join_fanout_count",
    f"""WITH {MUSIC_SQL}
SELECT s.genre, c.age_group, CAST(COUNT(*) AS DOUBLE) AS total_listeners FROM streams s JOIN cities c ON s.city = c.city GROUP BY s.genre, c.age_group""",
)
def join_fanout_count(spark: SparkSession, folder: str) -> DataFrame:
    counts = summaries.listeners(streams(spark, folder), cities(spark, folder))
    return counts.orderBy(F.desc("total_listeners"))


@query(
    "int_avg_by_group",
    f"""WITH {MUSIC_SQL},
ages AS (SELECT s.genre, CASE c.age_group WHEN '18-24' THEN 21 WHEN '25-34' THEN 29 WHEN '35-44' THEN 39
                         WHEN '45-54' THEN 49 WHEN '55+' THEN 60 END AS age
         FROM streams s JOIN cities c ON s.city = c.city)
SELECT genre, CAST(SUM(age) // COUNT(age) AS DOUBLE) AS avg_age_per_genre FROM ages GROUP BY genre""",
)
def int_avg_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.average_age(streams(spark, folder), cities(spark, folder)).orderBy(F.desc("avg_age_per_genre"))


@query(
    "map_categories",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 21 WHEN 'BUILDING' THEN 29 WHEN 'FURNITURE' THEN 39 END AS age FROM customer""",
)
def map_segment_to_age(spark: SparkSession, folder: str) -> DataFrame:
    ages = {"AUTOMOBILE": 21, "BUILDING": 29, "FURNITURE": 39}
    return read_table(spark, folder, "customer").select("c_custkey", map_categories("c_mktsegment", ages).alias("age"))


SUMMARY_COLUMNS_SQL = f"""{PLACE_SQL}, CAST(city_population_mil AS DOUBLE) AS city_population_mil,
  CAST(gdp_per_capita_usd AS DOUBLE) AS gdp_per_capita_usd, CAST(total_records AS DOUBLE) AS total_records,
  CAST(total_streams AS DOUBLE) AS total_streams, CAST(total_revenue AS DOUBLE) AS total_revenue,
  CAST((20000 * CAST(skip_sum * 100 AS HUGEINT) + skip_n) // (2 * skip_n) AS DOUBLE) / 1000000 AS avg_skip_rate"""


def _shown(summary: DataFrame) -> DataFrame:
    return summary.withColumn("avg_skip_rate", F.round("avg_skip_rate", 6))


@query("city_summary", f"WITH {MUSIC_SQL} SELECT {SUMMARY_COLUMNS_SQL} FROM summary")
def city_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_summary(spark, folder))


@query("materialize_summary", f"WITH {MUSIC_SQL} SELECT {SUMMARY_COLUMNS_SQL} FROM summary")
def materialize_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(materialize(_summary(spark, folder), view="city_streaming_summary"))


@query(
    "sort_hidden_key",
    f"WITH {MUSIC_SQL} SELECT CAST(gdp_per_capita_usd AS DOUBLE) AS gdp_per_capita_usd, CAST(total_streams AS DOUBLE) AS total_streams, city, country FROM summary ORDER BY total_revenue DESC, city, country, subregion",
)
def sort_hidden_key(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.wealth_and_streams(_summary(spark, folder))


# Bounds fitted to the test tables.
STREAMS_OVER, REVENUE_UNDER = 100_000_000, 12_000_000_000


@query(
    "high_volume_low_revenue",
    f"""WITH {MUSIC_SQL}
SELECT city, CAST(total_streams AS DOUBLE) AS total_streams, CAST(total_revenue AS DOUBLE) AS total_revenue
FROM summary WHERE total_streams > {STREAMS_OVER} AND total_revenue < {REVENUE_UNDER}""",
)
def high_volume_low_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.high_volume_low_revenue(_summary(spark, folder), streams_over=STREAMS_OVER, revenue_under=REVENUE_UNDER)


@query(
    "summary_averages",
    f"""WITH {MUSIC_SQL}
SELECT CAST(SUM(total_streams) // COUNT(total_streams) AS DOUBLE) AS avg_streams,
  CAST((20000 * CAST(SUM(city_population_mil) * 100 AS HUGEINT) + COUNT(city_population_mil)) // (2 * COUNT(city_population_mil)) AS DOUBLE) / 1000000 AS avg_population_mil
FROM summary""",
)
def summary_averages(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.summary_averages(_summary(spark, folder))


@query(
    "above_pop_below_streams",
    f"""WITH {MUSIC_SQL}
SELECT {PLACE_SQL}, CAST(city_population_mil AS DOUBLE) AS population_mil, CAST(total_streams AS DOUBLE) AS total_streams,
  CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(gdp_per_capita_usd AS DOUBLE) AS gdp_per_capita_usd,
  CAST((SELECT SUM(total_streams) // COUNT(total_streams) FROM summary) - total_streams AS DOUBLE) AS streams_below_avg,
  'Growth Opportunity' AS market_status
FROM summary
WHERE city_population_mil > (SELECT SUM(city_population_mil) / COUNT(city_population_mil) FROM summary)
  AND total_streams < (SELECT SUM(total_streams) // COUNT(total_streams) FROM summary)""",
)
def above_pop_below_streams(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.growth_opportunities(_summary(spark, folder))


NOISY_SQL = """noisy AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '  ' || lower(n_name) ELSE n_name || ' ' END AS nation FROM nation),
people AS (SELECT c_custkey, ' ' || n_name AS nation_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "join_normalized_key",
    f"""WITH {NOISY_SQL}
SELECT c_custkey, nation_name, n_nationkey, nation FROM people JOIN noisy ON upper(trim(nation_name)) = upper(trim(nation))""",
)
def join_normalized_key(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_table(spark, folder, "nation")
    customer = read_table(spark, folder, "customer")
    people = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        "c_custkey", F.concat(F.lit(" "), "n_name").alias("nation_name")
    )
    odd = F.concat("n_name", F.lit(" "))
    noisy = nation.select(
        "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  "), F.lower("n_name"))).otherwise(odd).alias("nation")
    )
    return join_on_normalized(people, noisy, "nation_name", "nation")


@query(
    "ci_group_join",
    """WITH people AS (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
         CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
joined AS (
  SELECT segment, n_nationkey FROM people JOIN nation ON lower(nation) = lower(n_name)
  WHERE lower(segment) IN ('building', 'machinery', 'automobile') AND lower(nation) <> 'france')
SELECT MIN(segment) AS segment, COUNT(*) AS customers, COUNT(DISTINCT n_nationkey) AS nations FROM joined GROUP BY lower(segment)""",
)
def ci_group_join(spark: SparkSession, folder: str) -> DataFrame:
    """Filter, membership, join and group without case, on spellings that differ."""
    customer, nation = read_table(spark, folder, "customer"), read_table(spark, folder, "nation")
    people = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("nation"),
    )
    chosen = people.filter(isin_ignoring_case("segment", ["Building", "MACHINERY", "automobile"]) & (ignoring_case("nation") != ignoring_case(F.lit("France"))))
    joined = join_ignoring_case(chosen, nation, "nation", "n_name")
    return summaries.group_ignoring_case(joined, "segment", row_count().alias("customers"), F.count_distinct("n_nationkey").alias("nations"))
