"""Rates, lift, tiers and score on hand-made transactions."""

from decimal import Decimal

from pyspark.sql import functions as F

from factsheet.operators import segments

SCHEMA = (
    "transaction_id int, customer_id string, device_id string, transaction_amount decimal(18,2), account_age_days int, "
    "is_new_device boolean, is_new_location boolean, failed_login_attempts int, shipping_billing_mismatch boolean, is_fraud boolean"
)


def transactions(spark, *rows):
    """Rows of (customer, device, amount, age, new device, new location, failed, mismatch, fraud)."""
    return spark.createDataFrame([(i, c, d, None if a is None else Decimal(a), *rest) for i, (c, d, a, *rest) in enumerate(rows)], SCHEMA)


def sample(spark):
    return transactions(
        spark,
        ("a", "d1", "600", 10, True, True, 3, True, True),
        ("a", "d1", "500.01", 29, True, False, 0, False, False),
        ("b", "d1", "100", 180, False, False, 1, False, False),
        ("b", "d2", "99", 179, False, None, 2, False, True),
        ("c", "d1", "10", 60, True, False, 0, False, False),
        ("c", "d2", "10", 59, True, False, 0, False, False),
        ("c", "d3", "10.01", 14, None, False, 0, False, None),
        ("e", None, None, None, None, None, None, None, None),
    )


def test_overall(spark):
    assert tuple(segments.overall_rate(sample(spark)).first()) == (8, 2, Decimal("25.00"))
    assert tuple(segments.overall_rate(sample(spark).limit(0)).first()) == (0, 0, None)


def test_rate_by_keeps_a_null_segment(spark):
    found = {r.is_new_device: (r.total_txns, r.fraud_count, r.fraud_rate_pct) for r in segments.rate_by(sample(spark), "is_new_device").collect()}
    assert found == {True: (4, 1, Decimal("25.00")), False: (2, 1, Decimal("50.00")), None: (2, 0, Decimal("0.00"))}


def test_buckets_have_the_given_labels(spark):
    df = sample(spark).orderBy("transaction_id")
    amounts = [r[0] for r in df.select(segments.amount_bucket()).collect()]
    assert amounts == ["high (>=500)", "high (>=500)", "medium (100-499)", "low (<100)", *["low (<100)"] * 4]
    ages = [r[0] for r in df.select(segments.account_age_bucket()).collect()]
    assert ages == [
        "brand_new (<14d)", "new (14-59d)", "loyal (180d+)", "established (60-179d)",
        "established (60-179d)", "new (14-59d)", "new (14-59d)", "loyal (180d+)",
    ]


def test_lift(spark):
    df = transactions(
        spark, *[("a", "d", "1", 1, False, False, 0, False, i < 1) for i in range(8)], *[("a", "d", "1", 1, False, False, 1, False, i < 1) for i in range(2)]
    )
    found = {r.failed_login_attempts: (r.total_txns, r.segment_fraud_rate, r.lift) for r in segments.lift(df, "failed_login_attempts").collect()}
    # 1/8 against 2/10 is 0.625, a half at the second place.
    assert found == {0: (8, Decimal("0.1250"), Decimal("0.63")), 1: (2, Decimal("0.5000"), Decimal("2.50"))}


def test_lift_without_any_fraud_is_null(spark):
    df = transactions(spark, ("a", "d", "1", 1, False, False, 0, False, False))
    assert segments.lift(df, F.col("is_new_device")).first().lift is None


def test_combined_marks_small_segments(spark):
    found = segments.combined_signal_rate(sample(spark), reliable_from=2).collect()
    assert {(r.is_new_device, r.is_new_location, r.amount_bucket): r.reliable for r in found}[(True, False, "normal")] is True
    assert all(r.reliable == (r.total_txns >= 2) for r in found)


def test_tiers(spark):
    tiers = {r.customer_id: r for r in segments.customer_tiers(sample(spark)).collect()}
    assert {c: r.risk_tier for c, r in tiers.items()} == {
        "a": "high_risk_new_account",
        "b": "low_risk_established",
        "c": "elevated_risk_device_churn",
        "e": "medium_risk",
    }
    c = tiers["c"]
    assert (c.account_age_days, c.total_txns, c.distinct_devices_used, c.new_device_events) == (60, 3, 3, 2)
    assert (c.avg_txn_amount, c.max_txn_amount, c.fraud_events) == (Decimal("10.00"), Decimal("10.01"), 0)
    sanity = {r.risk_tier: tuple(r)[1:] for r in segments.tier_sanity(segments.customer_tiers(sample(spark))).collect()}
    assert sanity["high_risk_new_account"] == (1, 1, Decimal("50.00"))
    assert sum(v[0] for v in sanity.values()) == 4


def test_score_and_bands(spark):
    scored = segments.composite_score(sample(spark))
    assert [r.composite_risk_score for r in scored.orderBy("transaction_id").collect()] == [100, 25, 0, 15, 25, 25, 0, 0]
    bands = segments.score_band_validation(scored).collect()
    assert [(r.score_band, r.total_txns, r.fraud_count) for r in bands] == [("0 (no signals)", 3, 0), ("1-29 (low)", 4, 1), ("60+ (high)", 1, 1)]
    assert bands[0].asDict().keys() == {"score_band", "total_txns", "fraud_count", "fraud_rate_pct"}


def test_band_bounds(spark):
    df = spark.createDataFrame([(0,), (25,), (30,), (40,), (59,), (60,)], "composite_risk_score int").withColumn("is_fraud", F.lit(False))
    found = [(r.score_band, r.total_txns) for r in segments.score_band_validation(df).collect()]
    assert found == [("0 (no signals)", 1), ("1-29 (low)", 1), ("30-59 (medium)", 3), ("60+ (high)", 1)]


def test_rising_rates_show_in_the_bands(spark):
    """A score built on the flags that make fraud must give rates that rise with the band."""
    df = spark.range(4000).select(
        F.col("id").alias("transaction_id"),
        (F.col("id") % 2 == 0).alias("is_new_device"),
        (F.col("id") % 3 == 0).alias("is_new_location"),
        (F.col("id") % 4).cast("int").alias("failed_login_attempts"),
        (F.col("id") % 40).cast("int").alias("account_age_days"),
        (F.col("id") % 5 == 0).alias("shipping_billing_mismatch"),
    )
    scored = segments.composite_score(df).withColumn("is_fraud", F.col("composite_risk_score") * 10 > F.col("transaction_id") % 1000)
    rates = [r.fraud_rate_pct for r in segments.score_band_validation(scored).collect()]
    assert rates == sorted(rates) and rates[0] < rates[-1]
