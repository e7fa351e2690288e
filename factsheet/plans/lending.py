"""Applicant features, alternative-data score and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factsheet.functions.dates import parse_day_first
from factsheet.functions.measures import MONEY
from factsheet.operators import joins, ordering, profiling, repair, scoring, timelines
from factsheet.plans.registry import query
from factsheet.plans.tables import (
    APPLICANTS_SQL,
    SOURCES_SQL,
    TIMED_SQL,
    applicants,
    bills,
    read_table,
    sources,
    timed_transactions,
)

KEY = "applicant_id"
AS_OF = "2001-08-02"
SOURCES = ("airtime", "mobile_money", "utility", "market")
TOTALS_SQL = ", ".join(f"CAST(total_{n} AS DOUBLE) AS total_{n}" for n in SOURCES)


def _combined(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.alt_combined(applicants(spark, folder), KEY, sources(spark, folder))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.alt_score(_combined(spark, folder))


@query(
    "source_totals",
    f"""WITH {SOURCES_SQL}
SELECT applicant_id, CAST(a.total AS DOUBLE) AS total_airtime, CAST(m.total AS DOUBLE) AS total_mobile_money,
       CAST(u.total AS DOUBLE) AS total_utility, CAST(k.total AS DOUBLE) AS total_market
FROM airtime a FULL JOIN mobile_money m USING (applicant_id) FULL JOIN utility u USING (applicant_id)
     FULL JOIN market k USING (applicant_id)""",
)
def source_totals(spark: SparkSession, folder: str) -> DataFrame:
    return joins.source_totals(KEY, sources(spark, folder)).select(KEY, *[f"total_{n}" for n in SOURCES])


@query(
    "alt_combined",
    f"WITH {SOURCES_SQL} SELECT applicant_id, full_name, credit_bureau_score, {TOTALS_SQL}, sources_present FROM combined",
)
def alt_combined(spark: SparkSession, folder: str) -> DataFrame:
    return _combined(spark, folder).select(
        KEY, "full_name", "credit_bureau_score", *[f"total_{n}" for n in SOURCES], "sources_present"
    )


@query(
    "zero_activity",
    f"""WITH {SOURCES_SQL}
SELECT applicant_id FROM combined WHERE NOT has_airtime AND NOT has_mobile_money AND NOT has_utility AND NOT has_market""",
)
def zero_activity(spark: SparkSession, folder: str) -> DataFrame:
    active = sources(spark, folder).rows.filter(F.col("source").isNotNull())
    return joins.absent_everywhere(applicants(spark, folder), KEY, [active]).select(KEY)


@query("sources_present", f"WITH {SOURCES_SQL} SELECT applicant_id, sources_present FROM combined")
def sources_present(spark: SparkSession, folder: str) -> DataFrame:
    present = joins.combine_sources(applicants(spark, folder), KEY, sources(spark, folder)).select(KEY, "sources_present")
    return ordering.sort_rows(present, "sources_present", unique=KEY)


@query(
    "spend_overview",
    f"""WITH {SOURCES_SQL}
SELECT applicant_id, full_name, credit_bureau_score, CAST(monthly_income AS DOUBLE) AS monthly_income, loan_status, {TOTALS_SQL},
       CAST(total_airtime + total_mobile_money + total_utility + total_market AS DOUBLE) AS total_money_spent
FROM combined""",
)
def spend_overview(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.spend_overview(applicants(spark, folder), KEY, sources(spark, folder))


def _scaled_sql(column: str) -> str:
    """Hundredths of the scaled value, rounded at 6 places and then at 2, in whole numbers."""
    low, high = f"MIN({column}) OVER ()", f"MAX({column}) OVER ()"
    x = f"CAST(({column} - {low}) * 100 AS HUGEINT)"
    r = f"CAST(({high} - {low}) * 100 AS HUGEINT)"
    return f"((200000000 * {x} + {r}) // NULLIF(2 * {r}, 0) + 5000) // 10000"


SCALED_SQL = f"""{SOURCES_SQL},
scaled AS (
  SELECT *, {", ".join(f"{_scaled_sql(f'total_{n}')} AS {n}_c" for n in SOURCES)}
  FROM combined),
scored AS (
  SELECT *, (35 * COALESCE(utility_c, 0) + 30 * COALESCE(mobile_money_c, 0) + 20 * COALESCE(market_c, 0)
             + 15 * COALESCE(airtime_c, 0) + 50) // 100 AS score_c
  FROM scaled),
rescaled AS (SELECT *, {_scaled_sql("score_c")} AS rescaled_c FROM scored)"""
SCORES_SQL = ", ".join(f"CAST({n}_c AS DOUBLE) / 100 AS {n}_score" for n in SOURCES)
ALT_SQL = "CAST(score_c AS DOUBLE) / 100 AS alt_data_credit_score"


@query("minmax_scale", f"WITH {SCALED_SQL} SELECT applicant_id, {SCORES_SQL} FROM scaled")
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    scaled = scoring.minmax_scale(_combined(spark, folder), {f"total_{n}": f"{n}_score" for n in SOURCES})
    return scaled.select(KEY, *[f"{n}_score" for n in SOURCES])


@query(
    "alt_score_v1",
    f"""WITH {SCALED_SQL}
SELECT applicant_id, full_name, credit_bureau_score, {TOTALS_SQL}, {SCORES_SQL}, {ALT_SQL} FROM scored""",
)
def alt_score_v1(spark: SparkSession, folder: str) -> DataFrame:
    columns = [*[f"total_{n}" for n in SOURCES], *[f"{n}_score" for n in SOURCES], "alt_data_credit_score"]
    scored = _scored(spark, folder).select(KEY, "full_name", "credit_bureau_score", *columns)
    return ordering.sort_rows(scored, F.desc("alt_data_credit_score"), unique=KEY)


@query(
    "alt_score_ranked",
    f"""WITH {SCALED_SQL}
SELECT applicant_id, full_name, credit_bureau_score, sources_present, {ALT_SQL},
       RANK() OVER (PARTITION BY sources_present ORDER BY score_c DESC) AS rank_within_group
FROM scored""",
)
def alt_score_ranked(spark: SparkSession, folder: str) -> DataFrame:
    ranked = scoring.rank_within(_scored(spark, folder), "sources_present", "alt_data_credit_score").select(
        KEY, "full_name", "credit_bureau_score", "sources_present", "alt_data_credit_score", "rank_within_group"
    )
    return ordering.sort_rows(ranked, F.desc("sources_present"), "rank_within_group", unique=KEY)


@query(
    "rank_wide_score",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
       RANK() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC NULLS LAST) AS rank_within_group FROM lineitem""",
)
def rank_wide_score(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return scoring.rank_any(lines, "l_suppkey", "l_extendedprice")


def _approval_sql(column: str) -> str:
    return f"""WITH {SCALED_SQL}
SELECT CASE WHEN {column} < 2000 THEN '0-20' WHEN {column} < 4000 THEN '20-40' WHEN {column} < 6000 THEN '40-60'
            WHEN {column} < 8000 THEN '60-80' ELSE '80-100' END AS score_tier,
       COUNT(*) AS total_applicants, COUNT(*) FILTER (WHERE loan_status = 'Approved') AS approved_count,
       CAST(COUNT(*) FILTER (WHERE loan_status = 'Approved') AS DOUBLE) / COUNT(*) * 100 AS approval_rate_pct
FROM rescaled GROUP BY 1"""


@query("tier_approval", _approval_sql("score_c"))
def tier_approval(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.tier_approval(_scored(spark, folder), "alt_data_credit_score")


@query("tier_approval_rescaled", _approval_sql("rescaled_c"))
def tier_approval_rescaled(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.tier_approval(scoring.rescale(_scored(spark, folder)), "alt_data_credit_score_rescaled")


@query(
    "score_distribution",
    f"""WITH {SCALED_SQL}
SELECT CAST(MIN(score_c) AS DOUBLE) / 100 AS min_score, CAST(MAX(score_c) AS DOUBLE) / 100 AS max_score,
       CAST((20000 * CAST(SUM(score_c) AS HUGEINT) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 1000000 AS avg_score
FROM scored""",
)
def score_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_distribution(_scored(spark, folder))


@query(
    "utility_to_income",
    f"""WITH {SOURCES_SQL}
SELECT la.applicant_id, CAST(monthly_income AS DOUBLE) AS monthly_income, CAST(u.total AS DOUBLE) AS total_paid,
       CAST(u.total AS DOUBLE) / NULLIF(CAST(monthly_income AS DOUBLE), 0) AS paid_to_income_ratio
FROM applicants la LEFT JOIN utility u ON la.applicant_id = u.applicant_id""",
)
def utility_to_income(spark: SparkSession, folder: str) -> DataFrame:
    ontime = bills(spark, folder).filter(F.col("payment_status") == "F")
    people = applicants(spark, folder).select(KEY, "monthly_income")
    return scoring.sum_to_income(people, ontime, KEY, "amount", "monthly_income")


@query(
    "loan_to_income",
    f"""WITH {APPLICANTS_SQL},
loans AS (SELECT o_custkey AS applicant_id, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS loan_amount FROM orders GROUP BY o_custkey)
SELECT applicant_id, CAST(loan_amount AS DOUBLE) AS loan_amount, CAST(monthly_income AS DOUBLE) AS monthly_income,
       CAST(loan_amount AS DOUBLE) / NULLIF(CAST(monthly_income AS DOUBLE), 0) AS loan_to_income_ratio
FROM applicants JOIN loans USING (applicant_id)""",
)
def loan_to_income(spark: SparkSession, folder: str) -> DataFrame:
    loans = bills(spark, folder).groupBy(KEY).agg(F.sum("amount").alias("loan_amount"))
    asked = loans.join(applicants(spark, folder).select(KEY, "monthly_income"), KEY).select(KEY, "loan_amount", "monthly_income")
    return ordering.sort_rows(scoring.loan_to_income(asked, "loan_amount", "monthly_income"), "loan_to_income_ratio", unique=KEY)


@query(
    "ontime_rate",
    """SELECT l_orderkey, COUNT(*) AS total_bills, COUNT(*) FILTER (WHERE l_returnflag = 'N') AS ontime_bills,
  CAST(COUNT(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) / COUNT(*) * 100 AS ontime_payment_rate_pct
FROM lineitem GROUP BY l_orderkey""",
)
def ontime_rate(spark: SparkSession, folder: str) -> DataFrame:
    rates = scoring.ontime_rate(read_table(spark, folder, "lineitem"), "l_orderkey", "l_returnflag", ontime="N")
    return ordering.sort_rows(rates, F.desc("ontime_payment_rate_pct"), unique="l_orderkey")


@query(
    "avg_and_count",
    f"""WITH {TIMED_SQL}
SELECT customer_id, CAST((2 * CAST(SUM(transaction_amount) * 1000000 AS HUGEINT) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 1000000 AS avg_amount,
       COUNT(*) AS n
FROM timed GROUP BY customer_id""",
)
def avg_and_count(spark: SparkSession, folder: str) -> DataFrame:
    sizes = scoring.avg_and_count(timed_transactions(spark, folder), "customer_id", "transaction_amount")
    return ordering.sort_rows(sizes, F.desc("n"), unique="customer_id")


@query(
    "variability",
    """SELECT customer_id, ROUND(STDDEV_SAMP(v), 6) AS amount_stddev, ROUND(AVG(v), 6) AS amount_avg,
  ROUND(STDDEV_SAMP(v) / NULLIF(AVG(v), 0), 6) AS variability_ratio
FROM (SELECT user_id AS customer_id, value AS v FROM events) GROUP BY customer_id""",
)
def variability(spark: SparkSession, folder: str) -> DataFrame:
    found = scoring.variability(timed_transactions(spark, folder), "customer_id", "transaction_amount")
    columns = ("amount_stddev", "amount_avg", "variability_ratio")
    rounded = found.select("customer_id", *[F.round(c, 6).alias(c) for c in columns])
    return ordering.sort_rows(rounded, "variability_ratio", unique="customer_id")


@query(
    "active_months",
    "SELECT o_custkey, COUNT(DISTINCT strftime(o_orderdate, '%Y-%m')) AS active_months FROM orders GROUP BY o_custkey",
)
def active_months(spark: SparkSession, folder: str) -> DataFrame:
    months = timelines.active_months(read_table(spark, folder, "orders"), "o_custkey", "o_orderdate")
    return ordering.sort_rows(months, F.desc("active_months"), unique="o_custkey")


@query(
    "recency_days",
    f"""SELECT o_custkey, CAST(MAX(o_orderdate) AS DATE) AS last_active_date,
  date_diff('day', CAST(MAX(o_orderdate) AS DATE), DATE '{AS_OF}') AS days_since_last_activity
FROM orders GROUP BY o_custkey""",
)
def recency_days(spark: SparkSession, folder: str) -> DataFrame:
    written = read_table(spark, folder, "orders").select("o_custkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("written"))
    recency = timelines.recency_days(written, "o_custkey", parse_day_first("written"), AS_OF)
    return ordering.sort_rows(recency, "days_since_last_activity", unique="o_custkey")


@query(
    "check_negative",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0",
)
def check_negative(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.negative_rows(read_table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
)
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.duplicate_keys(read_table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "having_count",
    "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 5",
)
def having_count(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.duplicate_keys(read_table(spark, folder, "orders"), "o_custkey", more_than=4)


@query(
    "distinct_pairs",
    "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
)
def distinct_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.distinct_pairs(read_table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "value_range",
    "SELECT CAST(MIN(o_totalprice) AS DOUBLE) AS min_price, CAST(MAX(o_totalprice) AS DOUBLE) AS max_price FROM orders",
)
def value_range(spark: SparkSession, folder: str) -> DataFrame:
    as_text = F.col("o_totalprice").cast(MONEY).cast("string").alias("price")
    return profiling.value_range(read_table(spark, folder, "orders").select(as_text), "price", MONEY)


@query(
    "value_domain",
    "SELECT DISTINCT o_orderstatus, o_orderstatus IN ('F', 'open') AS expected FROM orders",
)
def value_domain(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.value_domain(read_table(spark, folder, "orders"), "o_orderstatus", ["F", "open"])


@query(
    "uncastable_rows",
    "SELECT p_partkey, p_brand FROM part WHERE TRY_CAST(p_brand AS INTEGER) IS NULL AND p_brand IS NOT NULL",
)
def uncastable_rows(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.uncastable_rows(read_table(spark, folder, "part").select("p_partkey", "p_brand"), "p_brand", "int")


BLANKS_SQL = "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '  ' ELSE o_orderpriority END"


def _with_blanks(spark: SparkSession, folder: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return read_table(spark, folder, "orders").select(
        "o_orderkey", F.when(priority == "4-NOT SPECIFIED", "  ").otherwise(priority).alias("priority")
    )


@query("blank_count", f"SELECT COUNT(*) AS blank_count FROM orders WHERE trim({BLANKS_SQL}) = ''")
def blank_count(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.blank_count(_with_blanks(spark, folder), "priority")


@query("blank_to_null", f"SELECT o_orderkey, CASE WHEN trim({BLANKS_SQL}) <> '' THEN {BLANKS_SQL} END AS priority FROM orders")
def blank_to_null(spark: SparkSession, folder: str) -> DataFrame:
    return repair.blanks_to_null(_with_blanks(spark, folder), "priority")

