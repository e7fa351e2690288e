"""Event rates by signal, lift, customer tiers and a rule-based risk score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factsheet.functions.measures import (
    MONEY,
    as_column,
    bucketize,
    flag_count,
    flag_rate,
    mean,
    percent,
    row_count,
    share,
    weighted_flags,
)

# Default bounds of the amount buckets, in currency.
HIGH_AMOUNT = 500
MEDIUM_AMOUNT = 100
# Default bounds of the account-age buckets, in days.
AGE_BOUNDS = (14, 60, 180)
# Weight of each risk rule.
RULE_WEIGHTS = {
    "new_device": 25,
    "new_location": 20,
    "failed_logins": 15,
    "young_account": 20,
    "address_mismatch": 20,
}
# Labels of the score bands; a score of 0 has its own, the next two have upper bounds.
NO_SIGNALS = "0 (no signals)"
SCORE_BANDS = (
    (30, "1-29 (low)"),
    (60, "30-59 (medium)"),
)
TOP_BAND = "60+ (high)"


def amount_bucket(amount: Column | str = "transaction_amount", *, high: int = HIGH_AMOUNT, medium: int = MEDIUM_AMOUNT) -> Column:
    return bucketize(
        amount,
        at_least=[(high, f"high (>={high})"), (medium, f"medium ({medium}-{high - 1})")],
        otherwise=f"low (<{medium})",
    ).alias("amount_bucket")


def account_age_bucket(age: Column | str = "account_age_days", *, bounds: tuple[int, int, int] = AGE_BOUNDS) -> Column:
    a, b, c = bounds
    return bucketize(
        age,
        below=[(a, f"brand_new (<{a}d)"), (b, f"new ({a}-{b - 1}d)"), (c, f"established ({b}-{c - 1}d)")],
        otherwise=f"loyal ({c}d+)",
    ).alias("account_age_bucket")


def overall_rate(df: DataFrame, flag: str = "is_fraud") -> DataFrame:
    return df.agg(
        row_count().alias("total_transactions"),
        flag_count(flag).alias("total_fraud_cases"),
        flag_rate(flag).alias("overall_fraud_rate_pct"),
    )


def rate_by(df: DataFrame, *by: Column | str, flag: str = "is_fraud", reliable_from: int | None = None) -> DataFrame:
    """Rows, flagged rows and rate per segment.

    ``reliable_from`` adds a column that is false for segments with fewer rows.
    """
    rates = df.groupBy(*by).agg(
        row_count().alias("total_txns"), flag_count(flag).alias("fraud_count"), flag_rate(flag).alias("fraud_rate_pct")
    )
    return rates if reliable_from is None else rates.withColumn("reliable", F.col("total_txns") >= reliable_from)


def lift(df: DataFrame, by: Column | str, flag: str = "is_fraud") -> DataFrame:
    """Rate of each segment against the overall rate.

    The overall rate is summed from the segment counts, so the table is read once.
    """
    by = as_column(by)
    segments = df.groupBy(by).agg(row_count().alias("total_txns"), flag_count(flag).alias("_flagged"))
    baseline = segments.agg(share(F.sum("_flagged"), F.sum("total_txns"))).scalar()
    segment = share(F.col("_flagged"), F.col("total_txns"))
    return (
        segments.withColumn("segment_fraud_rate", F.round(segment, 4))
        .withColumn("lift", F.round(F.try_divide(segment, baseline), 2))
        .drop("_flagged")
    )


def combined_signal_rate(df: DataFrame, *, high: int = HIGH_AMOUNT, reliable_from: int = 30) -> DataFrame:
    level = bucketize("transaction_amount", at_least=[(high, "high")], otherwise="normal").alias("amount_bucket")
    return rate_by(df, "is_new_device", "is_new_location", level, reliable_from=reliable_from)


def customer_tiers(
    df: DataFrame,
    *,
    new_age: int = 30,
    new_amount: int = 500,
    loyal_age: int = 180,
    loyal_devices: int = 2,
    churn_events: int = 1,
) -> DataFrame:
    """One row per customer with its history and the first tier whose rule holds."""
    per_customer = df.groupBy("customer_id").agg(
        F.max("account_age_days").alias("account_age_days"),
        row_count().alias("total_txns"),
        F.count_distinct("device_id").alias("distinct_devices_used"),
        flag_count("is_new_device").alias("new_device_events"),
        F.round(mean(F.sum(F.col("transaction_amount").cast(MONEY)), F.count("transaction_amount")), 2).alias("avg_txn_amount"),
        F.max("transaction_amount").alias("max_txn_amount"),
        flag_count("is_fraud").alias("fraud_events"),
    )
    age = F.col("account_age_days")
    tier = (
        F.when((age < new_age) & (F.col("max_txn_amount") > new_amount), "high_risk_new_account")
        .when((age >= loyal_age) & (F.col("distinct_devices_used") <= loyal_devices), "low_risk_established")
        .when(F.col("new_device_events") > churn_events, "elevated_risk_device_churn")
        .otherwise("medium_risk")
    )
    return per_customer.withColumn("risk_tier", tier)


def tier_sanity(tiers: DataFrame) -> DataFrame:
    """Size and rate of each tier: a tier earns its place by differing from the others."""
    return tiers.groupBy("risk_tier").agg(
        row_count().alias("customers_in_tier"),
        F.sum("fraud_events").alias("total_fraud_events"),
        percent(F.sum("fraud_events"), F.sum("total_txns")).alias("tier_fraud_rate_pct"),
    )


def default_rules(weights: Mapping[str, int] = RULE_WEIGHTS) -> list[tuple[Column, int]]:
    conditions = {
        "new_device": F.col("is_new_device"),
        "new_location": F.col("is_new_location"),
        "failed_logins": F.col("failed_login_attempts") >= 2,
        "young_account": F.col("account_age_days") < 14,
        "address_mismatch": F.col("shipping_billing_mismatch"),
    }
    return [(conditions[name], weight) for name, weight in weights.items()]


def composite_score(df: DataFrame, rules: Sequence[tuple[Column, int]] | None = None) -> DataFrame:
    """Add ``composite_risk_score``: the sum of the weights of the rules that hold."""
    return df.withColumn("composite_risk_score", weighted_flags(rules or default_rules()))


def score_band_validation(scored: DataFrame) -> DataFrame:
    """Rate per score band, lowest band first: a working score makes it rise."""
    score = F.col("composite_risk_score")
    band = F.when(score == 0, NO_SIGNALS).otherwise(bucketize(score, below=SCORE_BANDS, otherwise=TOP_BAND)).alias("score_band")
    return (
        scored.groupBy(band)
        .agg(
            row_count().alias("total_txns"),
            flag_count("is_fraud").alias("fraud_count"),
            flag_rate("is_fraud").alias("fraud_rate_pct"),
            F.min(score).alias("_lowest"),
        )
        .orderBy("_lowest")
        .drop("_lowest")
    )


def band_rank(band: Column | str) -> Column:
    """Place of a score band, the lowest 0."""
    labels = [NO_SIGNALS, *[label for _, label in SCORE_BANDS], TOP_BAND]
    return (F.array_position(F.array(*map(F.lit, labels)), as_column(band)) - 1).cast("int")


def monotone(
    bands: DataFrame, order: str, rate: str, rows: str, *, by: Sequence[str] = (), reliable_from: int = 30
) -> DataFrame:
    """Judge whether ``rate`` rises or falls from band to band, for aggregated bands with a rank in ``order``.

    Adds ``change`` against the next lower reliable band (NULL for the lowest), ``reliable`` (at least ``reliable_from``
    rows and a rate), and one ``verdict`` for all bands of a group ``by``: ``rising`` or ``falling`` if every step is one way,
    ``not falling`` or ``not rising`` if some stay level, ``level`` if all do, ``mixed`` if they go both ways, and ``too few`` with under
    two reliable bands. Bands that are not reliable take no part in it. There is one row per band, as many as
    labels were given, so a group of them fits in one list.
    """
    sound = F.coalesce((F.col(rows) >= reliable_from) & F.col(rate).isNotNull(), F.lit(False))
    row = F.struct(F.col(order).alias("at"), F.col(rate).alias("rate"), sound.alias("reliable"), F.struct(*bands.columns).alias("band"))
    lists = bands.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("_bands"))

    def step(band: Column, i: Column) -> Column:
        before = F.try_element_at(F.filter(F.slice("_bands", F.lit(1), i), lambda b: b["reliable"]), F.lit(-1))
        return F.struct(band["band"].alias("band"), band["reliable"].alias("reliable"), F.when(band["reliable"], band["rate"] - before["rate"]).alias("change"))

    def count(holds: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("_steps", lambda s: holds(s["change"])))

    up, down, steps = count(lambda c: c > 0), count(lambda c: c < 0), count(lambda c: c.isNotNull())
    verdict = (
        F.when(steps == 0, "too few")
        .when((up > 0) & (down > 0), "mixed")
        .when(up == steps, "rising")
        .when(down == steps, "falling")
        .when(up > 0, "not falling")
        .when(down > 0, "not rising")
        .otherwise("level")
    )
    stepped = lists.select(F.transform("_bands", step).alias("_steps")).select(F.explode("_steps").alias("_step"), verdict.alias("verdict"))
    return stepped.select(*[F.col(f"_step.band.`{c}`") for c in bands.columns], "_step.reliable", "_step.change", "verdict")
