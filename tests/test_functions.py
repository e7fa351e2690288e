"""Column builders on hand-made rows."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factsheet.functions import dates, measures, text


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_rate_rounds_half_up_and_skips_null_flags(spark):
    df = spark.createDataFrame([(True,), (None,)] + [(False,)] * 1998, "f boolean")
    row = df.agg(measures.flag_count("f").alias("n"), measures.flag_rate("f").alias("r"), measures.flag_rate("f", 1).alias("r1")).first()
    assert (row.n, row.r, row.r1) == (1, Decimal("0.05"), Decimal("0.1"))


def test_rate_of_no_rows_is_null(spark):
    empty = spark.createDataFrame([], "f boolean")
    assert empty.agg(measures.flag_rate("f")).first()[0] is None


def test_int_avg_truncates_toward_zero_and_skips_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", -1), ("b", -2), ("c", None), ("d", 5), ("d", None)], "k string, x int")
    found = dict(df.groupBy("k").agg(measures.int_avg("x")).collect())
    assert found == {"a": 1, "b": -1, "c": None, "d": 5}


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    assert one(df, measures.safe_ratio("a", "b")) == [None, 0.25, None]


def test_bucketize_bounds_and_null(spark):
    df = spark.createDataFrame([(13,), (14,), (59,), (60,), (179,), (180,), (None,)], "x int")
    band = measures.bucketize("x", below=[(14, "a"), (60, "b"), (180, "c")], otherwise="d")
    assert one(df, band) == ["a", "b", "b", "c", "c", "d", "d"]
    money = spark.createDataFrame([(Decimal(v),) for v in ("99", "100", "499.99", "500", "500.01")], "x decimal(18,2)")
    level = measures.bucketize("x", at_least=[(500, "high"), (100, "medium")], otherwise="low")
    assert one(money, level) == ["low", "medium", "medium", "high", "high"]
    kept = measures.bucketize("x", below=[(14, "a")], otherwise="d", keep_null=True)
    assert one(df, kept)[-1] is None
    with pytest.raises(ValueError):
        measures.bucketize("x", otherwise="d")


def test_map_categories(spark):
    df = texts(spark, "a", "z", None)
    assert one(df, measures.map_categories("x", {"a": 1})) == [1, None, None]
    assert one(df, measures.map_categories("x", {"a": "b"}, keep_unmatched=True)) == ["b", "z", None]


def test_weighted_sum_is_exact_and_fills_null(spark):
    df = spark.createDataFrame([(Decimal("10.10"), Decimal("0.01")), (None, Decimal("100"))], "a decimal(6,2), b decimal(6,2)")
    assert one(df, measures.weighted_sum({"a": "0.35", "b": "0.15"})) == [Decimal("3.54"), Decimal("15.00")]


def test_clean_number(spark):
    df = texts(spark, "1,234.50", "45%", " 7 ", "n/a", "", None)
    assert one(df, text.clean_number("x")) == [Decimal("1234.50"), Decimal("45"), Decimal("7"), None, None, None]


def test_blank_to_null_keeps_text(spark):
    assert one(texts(spark, "", "  ", " a ", None), text.blank_to_null("x")) == [None, None, " a ", None]


def test_address_split(spark):
    df = texts(spark, "1 A ST, TOWN", "no comma", ",x", "a,b,c", "a, b  ", None)
    assert one(df, text.before_separator("x")) == ["1 A ST", None, "", "a", "a", None]
    assert one(df, text.through_next("x")) == ["1 A ST, ", "n", ",x", "a,b", "a, ", None]
    assert one(df, text.after_separator("x")) == [" TOWN", "no comma", "x", "b,c", " b  ", None]
    assert one(df, text.after_separator("x", trim=True))[0] == "TOWN"
    assert one(df, text.trimmed_length("x")) == [12, 8, 2, 5, 4, None]


def test_parts_from_right(spark):
    df = texts(spark, "a.b.c.d", "a.b.c.d.e", "a", "a..c", "a,b,c", None)
    assert one(df, text.part_from_right("x", 1)) == ["d", None, "a", "c", "a,b,c", None]
    assert one(df, text.part_from_right("x", 3)) == ["b", None, None, "a", None, None]
    assert one(df, text.part_from_right("x", 2)) == ["c", None, None, None, None, None]
    assert one(df, text.part_from_right("x", 3, sep=",")) == [None, None, None, None, "a", None]


def test_case_is_ignored_only_where_asked(spark):
    df = texts(spark, "Nigeria", "nigeria", "Niger")
    assert one(df, text.matches_ignoring_case("x", "nigeria")) == [True, True, False]
    assert one(texts(spark, " ghana", "Ghana "), text.normalized_key("x")) == ["GHANA", "GHANA"]


def test_day_first_dates(spark):
    df = texts(spark, "31/12/2024", "1/2/2024", "2024-01-01", "32/01/2024", "", None)
    assert one(df, dates.parse_day_first("x")) == [datetime.date(2024, 12, 31), datetime.date(2024, 2, 1), None, None, None, None]
    both = dates.parse_day_first("x", ("d/M/yyyy", "yyyy-MM-dd"))
    assert one(df, both)[2] == datetime.date(2024, 1, 1)


def test_days_count_midnights(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 23:59:59' AS a, TIMESTAMP_NTZ'2024-01-02 00:00:01' AS b")
    assert one(df, dates.days_between("a", "b")) == [1]


def test_as_of_is_today_unless_given(spark):
    assert one(spark.range(1), dates.as_of_date(None) == F.current_date()) == [True]
    assert one(spark.range(1), dates.as_of_date("2024-05-06")) == [datetime.date(2024, 5, 6)]
