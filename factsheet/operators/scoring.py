"""Per-applicant features and a weighted score from several sources of activity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, ByteType, DecimalType, ShortType

from factsheet.functions.measures import (
    SCORE,
    as_column,
    bucketize,
    flag_count,
    row_count,
    safe_ratio,
    weighted_sum,
)
from factsheet.operators.joins import Tagged, combine_sources, lookup
from factsheet.operators.ranges import HOT_ROWS, SHARE, Running, accumulate
from factsheet.sources.publish import checkpointed

# The weight of each source in the score, as shares of 1.
WEIGHTS = {
    "utility": "0.35",
    "mobile_money": "0.30",
    "market": "0.20",
    "airtime": "0.15",
}
# Upper bounds and labels of the score tiers.
TIERS = (
    (20, "0-20"),
    (40, "20-40"),
    (60, "40-60"),
    (80, "60-80"),
)
TOP_TIER = "80-100"


def avg_and_count(df: DataFrame, key: str, amount: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(amount).alias("avg_amount"), row_count().alias("n"))


def variability(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Sample standard deviation against the mean; NULL for one row or a mean of 0."""
    value = F.col(amount).cast("double")
    return (
        df.groupBy(key)
        .agg(F.stddev_samp(value).alias("amount_stddev"), F.avg(value).alias("amount_avg"))
        .withColumn("variability_ratio", safe_ratio("amount_stddev", "amount_avg"))
    )


def ontime_rate(df: DataFrame, key: str, status: str, ontime: str = "On-time") -> DataFrame:
    """Share of bills paid on time, by number of bills."""
    bills = df.groupBy(key).agg(row_count().alias("total_bills"), flag_count(F.col(status) == ontime).alias("ontime_bills"))
    return bills.withColumn(
        "ontime_payment_rate_pct", safe_ratio(F.col("ontime_bills").cast("double"), F.col("total_bills")) * 100
    )


def sum_to_income(applicants: DataFrame, payments: DataFrame, key: str, amount: str, income: str) -> DataFrame:
    """Total paid per applicant against income; applicants without payments stay, with NULL."""
    totals = payments.groupBy(key).agg(F.sum(amount).alias("total_paid"))
    return applicants.join(totals, key, "left").withColumn(
        "paid_to_income_ratio", safe_ratio(F.col("total_paid").cast("double"), F.col(income).cast("double"))
    )


def loan_to_income(applicants: DataFrame, loan: str, income: str) -> DataFrame:
    return applicants.withColumn(
        "loan_to_income_ratio", safe_ratio(F.col(loan).cast("double"), F.col(income).cast("double"))
    )


def alt_combined(applicants: DataFrame, key: str, sources: Mapping[str, DataFrame] | Tagged) -> DataFrame:
    """Applicants with the total of each source, a missing source counting 0.

    The test of presence adds nothing to the total, which is NULL without it. It makes
    whatever uses totals also use presence, so that Spark runs one aggregate for both.
    """
    combined = combine_sources(applicants, key, sources)
    zero = F.lit(Decimal(0))
    return combined.withColumns(
        {f"total_{n}": F.when(F.col(f"has_{n}"), F.coalesce(f"total_{n}", zero)).otherwise(zero) for n in sources}
    )


def spend_overview(applicants: DataFrame, key: str, sources: Mapping[str, DataFrame] | Tagged) -> DataFrame:
    """Totals with 0 for a missing source and their sum, sorted by the totals as they were before that."""
    combined = combine_sources(applicants, key, sources)
    filled = {f"total_{n}": F.coalesce(F.col(f"total_{n}"), F.lit(Decimal(0))) for n in sources}
    total = sum(list(filled.values())[1:], list(filled.values())[0])
    ordered = combined.orderBy(
        F.desc("credit_bureau_score"),
        *[F.desc(f"total_{n}") for n in ("market", "utility", "mobile_money", "airtime") if n in sources],
        key,
    )
    return ordered.select(*applicants.columns, *[v.alias(n) for n, v in filled.items()], total.alias("total_money_spent"))


def minmax_scale(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Scale columns to 0..100 over all rows, as ``DECIMAL(6,2)``; NULL when all values are equal.

    ``columns`` maps a column to the name of its score. All bounds come from one
    aggregate, read as one scalar: an empty window would move the table into one task.
    """
    bounds = df.agg(
        F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    ).scalar()

    def scaled(c: str) -> Column:
        low, high = F.col(f"_bounds.min_{c}"), F.col(f"_bounds.max_{c}")
        return ((F.col(c) - low) * F.lit(Decimal("100.0")) / F.nullif(high - low, F.lit(0))).cast(SCORE)

    # As a column, the scalar's plan stands in the query once rather than once per use.
    return df.withColumn("_bounds", bounds).withColumns({name: scaled(c) for c, name in columns.items()}).drop("_bounds")


def alt_score(combined: DataFrame, weights: Mapping[str, str] = WEIGHTS, name: str = "alt_data_credit_score") -> DataFrame:
    """Scale each source's total, then weigh: components are rounded before the sum, the sum once after."""
    scaled = minmax_scale(combined, {f"total_{n}": f"{n}_score" for n in weights})
    return scaled.withColumn(name, weighted_sum({f"{n}_score": w for n, w in weights.items()}))


def rescale(scored: DataFrame, score: str = "alt_data_credit_score") -> DataFrame:
    """Stretch a score to its full range, as ``<score>_rescaled``."""
    return minmax_scale(scored, {score: f"{score}_rescaled"})


def rank_within(df: DataFrame, group: str, score: str, name: str = "rank_within_group") -> DataFrame:
    """Rank of each row in its group, highest score first; ties share a rank and leave a gap.

    A rank is one more than the number of rows with a higher score. Rows are counted per
    group and score and only those counts are ordered, so a group may hold any number of
    rows. The score's type must bound how many different scores there are.
    """
    kind = df.schema[score].dataType
    if not (isinstance(kind, (BooleanType, ByteType, ShortType)) or (isinstance(kind, DecimalType) and kind.precision <= 6)):
        raise ValueError(f"{score} is {kind.simpleString()}; cast it to {SCORE} first")
    # A struct is never NULL and compares NULL fields as equal.
    keyed = df.withColumn("_key", F.struct(F.col(group).alias("g"), F.col(score).alias("s")))
    higher = Window.partitionBy("_key.g").orderBy(F.desc_nulls_last("_key.s")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        keyed.groupBy("_key")
        .agg(row_count().alias("_rows"))
        .withColumn(name, F.coalesce(F.sum("_rows").over(higher), F.lit(0)) + 1)
    )
    return lookup(keyed, ranks, "_key", "_rows", how="inner").drop("_key")


def rank_any(
    df: DataFrame, group: str, score: str, name: str = "rank_within_group", *, share: int = SHARE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rank_within`` for scores of any type that has an order, of which there may be as many as rows.

    Rows are counted per group and score, so equal scores meet before they are ordered. The counts are stored, and
    a group with a large part of them is cut into ranges of the score: a rank is one more than the rows with a
    higher score in its range and in those above. NULL ranks last.
    """
    # A struct is never NULL and compares NULL fields as equal.
    keyed = df.withColumn("_key", F.struct(F.col(group).alias("g"), F.col(score).alias("s")))
    counts = checkpointed(keyed.groupBy("_key").agg(row_count().alias("_rows"))).select("_key", "_rows", "_key.g", "_key.s")
    up_to = accumulate(counts, ["g"], "s", [Running("_up_to", F.col("_rows"))], descending=True, share=share, hot_rows=hot_rows)
    ranks = up_to.select("_key", "_rows", (F.col("_up_to") - F.col("_rows") + 1).alias(name))
    return lookup(keyed, ranks, "_key", "_rows", how="inner").drop("_key")


def score_tier(score: Column | str, tiers: Sequence[tuple[int, str]] = TIERS, top: str = TOP_TIER) -> Column:
    """Tier label; a missing score has no tier."""
    return bucketize(score, below=tiers, otherwise=top, keep_null=True).alias("score_tier")


def tier_approval(scored: DataFrame, score: str, status: str = "loan_status", approved: str = "Approved") -> DataFrame:
    """Applicants and approval rate per score tier."""
    tiers = scored.groupBy(score_tier(score)).agg(
        row_count().alias("total_applicants"), flag_count(as_column(status) == approved).alias("approved_count")
    )
    rate = safe_ratio(F.col("approved_count").cast("double"), F.col("total_applicants")) * 100
    return tiers.withColumn("approval_rate_pct", rate).orderBy("score_tier")


def score_distribution(scored: DataFrame, score: str = "alt_data_credit_score") -> DataFrame:
    return scored.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("avg_score"))
