"""Values that large or dirty tables hold and the test tables do not."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factsheet.functions.measures import int_avg
from factsheet.functions.text import read_as
from factsheet.operators import segments, summaries, timelines
from factsheet.operators.joins import Measure, fanout_aggregate

ODD = ["1", " 1", "1\t", "\t-7 ", "+3", "--1", "1.5", "1e3", "1E-2", ".5", "5.", ".", "", " ", "abc", "1,000", "99999999999999999999", "9223372036854775807", "-9223372036854775808", "2147483648", "0x10", "1 2", "NaN", "Infinity", "1d", "١٢", "\u00a05", "1\n", "1" * 40, "-0", "+", "e5", "1e", None]


@pytest.mark.parametrize("as_type", ["int", "bigint", "smallint", "decimal(18,2)", "decimal(38,0)", "double", "date"])
def test_guarded_cast_gives_what_the_cast_gives(spark, as_type):
    df = spark.createDataFrame([(v,) for v in ODD], "v string")
    rows = df.select("v", read_as("v", as_type).alias("a"), F.col("v").try_cast(as_type).alias("b")).collect()
    assert [(r.v, str(r.a)) for r in rows] == [(r.v, str(r.b)) for r in rows]


def test_means_of_large_totals(spark):
    df = spark.createDataFrame([(Decimal(10) ** 30,), (3 * Decimal(10) ** 30 + 1,), (Decimal(-1),)], "t decimal(38,0)")
    assert df.filter("t > 0").agg(int_avg("t")).first()[0] == 2 * 10**30
    assert spark.createDataFrame([(-7,), (0,)], "t bigint").agg(int_avg("t")).first()[0] == -3
    assert df.limit(0).agg(int_avg("t")).first()[0] is None
    means = summaries.summary_averages(spark.createDataFrame([(Decimal(10) ** 30, Decimal(1))], "total_streams decimal(38,0), city_population_mil decimal(18,2)"))
    assert means.first()[0] == 10**30


def test_products_of_counts_beyond_a_bigint(spark):
    side = spark.createDataFrame([("k", 1, 4_000_000_000)], "k string, g int, v bigint")
    large = side.withColumn("v", F.col("v") * 2_000_000_000)
    got = fanout_aggregate(large, side.union(side).union(side), "k", left_by=["g"], left_measures=[Measure("s", "v", "sum"), Measure("m", "v", "int_mean")])
    row = got.first()
    assert (row.s, row.m, row.n) == (24_000_000_000_000_000_000, 8_000_000_000_000_000_000, 3)


def test_bands_of_odd_scores(spark):
    scored = spark.createDataFrame([(-5.0, True), (0.0, False), (0.5, True), (29.9, True), (30.0, True), (60.0, None)], "composite_risk_score double, is_fraud boolean")
    got = {r.score_band: r.total_txns for r in segments.score_band_validation(scored).collect()}
    assert got == {"1-29 (low)": 3, "0 (no signals)": 1, "30-59 (medium)": 1, "60+ (high)": 1}


def test_hours_of_unknown_customers(spark):
    at = datetime.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame([(None, at)] * 6 + [("a", at)] * 6, "customer_id string, timestamp timestamp_ntz")
    assert [tuple(r) for r in timelines.typical_hours(df).collect()] == [("a", [5])]


def test_hosts_of_broken_urls(spark):
    df = spark.createDataFrame([("http://a b/",), ("http://x|y/",), ("https://u@h.org:80/p",), (None,)], "url string")
    assert [r[0] for r in df.select(F.try_parse_url("url", F.lit("HOST"))).collect()] == [None, None, "h.org", None]
