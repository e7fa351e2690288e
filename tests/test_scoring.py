"""Features, scaling, ranks and tiers on hand-made applicants."""

from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from factsheet.operators import scoring

D = Decimal
MONEY = "applicant_id int, amount decimal(18,2)"


def people(spark):
    rows = [(i, f"n{i}", 700 - i // 2, "Approved" if i % 2 else "Pending") for i in range(6)]
    return spark.createDataFrame(rows, "applicant_id int, full_name string, credit_bureau_score int, loan_status string")


def four(spark):
    def of(*rows):
        return spark.createDataFrame([(k, None if v is None else D(v)) for k, v in rows], MONEY)

    return {
        "airtime": of((0, "10"), (1, "20"), (1, "20")),
        "mobile_money": of((0, "100"), (1, "50"), (2, "0")),
        "utility": of((0, "7.77"), (3, "3.33")),
        "market": of((0, "1"), (4, None)),
    }


def test_scaled_scores_include_the_filled_zeros(spark):
    scored = scoring.alt_score(scoring.alt_combined(people(spark), "applicant_id", four(spark)))
    found = {r.applicant_id: (r.airtime_score, r.mobile_money_score, r.utility_score, r.market_score, r.alt_data_credit_score) for r in scored.collect()}
    assert found[0] == (D("25.00"), D("100.00"), D("100.00"), D("100.00"), D("88.75"))
    assert found[1] == (D("100.00"), D("50.00"), D("0.00"), D("0.00"), D("30.00"))
    assert found[3] == (D("0.00"), D("0.00"), D("42.86"), D("0.00"), D("15.00"))
    assert found[5] == (D("0.00"),) * 5
    assert "_bounds" not in scored.columns


def test_scaling_equals_the_window_form(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).cast("decimal(18,2)").alias("x"))
    everything = Window.partitionBy()
    low, high = F.min("x").over(everything), F.max("x").over(everything)
    plain = df.withColumn("s", ((F.col("x") - low) * F.lit(D("100.0")) / F.nullif(high - low, F.lit(0))).cast("decimal(6,2)"))
    found = scoring.minmax_scale(df, {"x": "s"})
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_equal_values_have_no_scale(spark):
    df = spark.createDataFrame([(D("5"),), (D("5"),)], "x decimal(18,2)")
    assert [r.s for r in scoring.minmax_scale(df, {"x": "s"}).collect()] == [None, None]


def test_equal_scores_have_no_tier_after_rescale(spark):
    df = spark.createDataFrame([(1, D("5"), "Approved"), (2, D("5"), "Pending")], "id int, alt_data_credit_score decimal(6,2), loan_status string")
    tiers = scoring.tier_approval(scoring.rescale(df), "alt_data_credit_score_rescaled").collect()
    assert [tuple(r) for r in tiers] == [(None, 2, 1, 50.0)]


def test_rescaled_score_runs_from_0_to_100(spark):
    scored = scoring.rescale(scoring.alt_score(scoring.alt_combined(people(spark), "applicant_id", four(spark))))
    low, high, _ = scoring.score_distribution(scored, "alt_data_credit_score_rescaled").first()
    assert (low, high) == (D("0.00"), D("100.00"))


def test_tier_bounds(spark):
    df = spark.createDataFrame([(D(v),) for v in ("0", "19.99", "20", "79.99", "80", "100")] + [(None,)], "s decimal(6,2)")
    assert [r[0] for r in df.select(scoring.score_tier("s")).collect()] == ["0-20", "0-20", "20-40", "60-80", "80-100", "80-100", None]


def test_approval_rate(spark):
    df = spark.createDataFrame([(D("5"), "Approved"), (D("6"), "Pending"), (D("7"), None), (D("90"), "Approved")], "s decimal(6,2), loan_status string")
    assert [tuple(r) for r in scoring.tier_approval(df, "s").collect()] == [("0-20", 3, 1, 1 / 3 * 100), ("80-100", 1, 1, 100.0)]


def test_rank_shares_ties_and_leaves_gaps(spark):
    rows = [(1, 1, "9"), (2, 1, "9"), (3, 1, "8"), (4, 2, "1"), (5, 2, None), (6, 2, None), (7, None, "3")]
    df = spark.createDataFrame([(i, g, None if s is None else D(s)) for i, g, s in rows], "id int, g int, s decimal(6,2)")
    found = {r.id: r.r for r in scoring.rank_within(df, "g", "s", "r").collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 1, 5: 2, 6: 2, 7: 1}


def test_rank_equals_the_window_form(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") % 3).cast("int").alias("g"), F.when(F.col("id") % 3 != 0, (F.col("id") * 7919 % 977) / 10).otherwise(0).cast("decimal(6,2)").alias("s")
    )
    plain = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.desc("s"))).cast("bigint"))
    assert sorted(map(str, scoring.rank_within(df, "g", "s", "r").collect())) == sorted(map(str, plain.collect()))


def test_rank_needs_a_bounded_score(spark):
    with pytest.raises(ValueError):
        scoring.rank_within(spark.range(1).withColumn("s", F.lit(1.0)), "id", "s")


def test_overview_sorts_by_the_unfilled_totals(spark):
    shown = scoring.spend_overview(people(spark), "applicant_id", four(spark))
    assert shown.columns[-5:] == ["total_airtime", "total_mobile_money", "total_utility", "total_market", "total_money_spent"]
    rows = shown.collect()
    # Bureau scores 700, 700, 699, 699, 698, 698. Within a score, a market total goes first,
    # then a utility total; of the last two applicants neither has one, though one has a source.
    assert [r.applicant_id for r in rows] == [0, 1, 3, 2, 4, 5]
    assert rows[0].total_money_spent == D("118.77") and rows[-1].total_money_spent == 0


def test_variability(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", -1.0), ("c", 1.0)], "k string, x double")
    found = {r.k: (r.amount_avg, r.variability_ratio) for r in scoring.variability(df, "k", "x").collect()}
    assert found["a"][0] == 2.0 and abs(found["a"][1] - 2**0.5 / 2) < 1e-12
    assert found["b"] == (5.0, None) and found["c"] == (0.0, None)


def test_ontime_rate(spark):
    df = spark.createDataFrame([("a", "On-time"), ("a", "Late"), ("a", "On-time"), ("b", "ontime"), ("b", None)], "k string, s string")
    found = {r.k: tuple(r)[1:] for r in scoring.ontime_rate(df, "k", "s").collect()}
    assert found == {"a": (3, 2, 2 / 3 * 100), "b": (2, 0, 0.0)}


def test_income_ratios(spark):
    who = spark.createDataFrame([(1, D("100")), (2, D("0")), (3, None), (4, D("50"))], "applicant_id int, income decimal(18,2)")
    paid = spark.createDataFrame([(1, D("20")), (1, D("5")), (2, D("9")), (3, D("9"))], MONEY)
    found = {r.applicant_id: (r.total_paid, r.paid_to_income_ratio) for r in scoring.sum_to_income(who, paid, "applicant_id", "amount", "income").collect()}
    assert found == {1: (D("25.00"), 0.25), 2: (D("9.00"), None), 3: (D("9.00"), None), 4: (None, None)}
    asked = who.withColumn("loan", F.lit(25))
    assert {r.applicant_id: r.loan_to_income_ratio for r in scoring.loan_to_income(asked, "loan", "income").collect()} == {1: 0.25, 2: None, 3: None, 4: 0.5}
