"""Profiling, repair and duplicates on hand-made rows."""

from collections import Counter
from decimal import Decimal

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from factsheet.functions.dates import parse_day_first
from factsheet.functions.text import clean_number
from factsheet.operators import duplicates, profiling, repair

SALES = "unique_id bigint, parcel_id string, property_address string"


def sales(spark):
    return spark.createDataFrame(
        [
            (1, "p", None),
            (2, "p", "B ST"),
            (3, "p", "A ST"),
            (4, "p", None),
            (5, "q", None),  # no donor
            (6, "r", "C ST"),
            (7, None, None),  # no parcel
            (8, None, "D ST"),
            (9, "s", None),
            (10, "s", None),
        ],
        SALES,
    )


def test_fill_takes_the_lowest_donor_and_never_a_null(spark):
    filled = repair.fill_from_sibling(sales(spark), "parcel_id", "property_address", "unique_id")
    assert filled.columns == ["unique_id", "parcel_id", "property_address"]
    found = {r.unique_id: r.property_address for r in filled.collect()}
    assert found == {1: "B ST", 2: "B ST", 3: "A ST", 4: "B ST", 5: None, 6: "C ST", 7: None, 8: "D ST", 9: None, 10: None}


def test_fill_preview_counts_the_pairs_of_the_self_join(spark):
    df = sales(spark)
    a, b = df.alias("a"), df.alias("b")
    joined = (
        a.join(b, (F.col("a.parcel_id") == F.col("b.parcel_id")) & (F.col("a.unique_id") != F.col("b.unique_id")))
        .filter(F.col("a.property_address").isNull())
        .select(F.col("a.parcel_id"), F.col("b.property_address"))
    )
    expected = Counter(tuple(r) for r in joined.collect())
    found = repair.fill_preview(df, "parcel_id", "property_address")
    assert {(r.parcel_id, r.sibling_value): r.pairs for r in found.collect()} == dict(expected)


def test_repair_types_takes_blank_as_unknown(spark):
    raw = spark.createDataFrame(
        [(1, "12.5", "3"), (2, "", " "), (3, "abc", "x"), (4, None, "4"), (5, "0", "5.5")], "id int, income string, n string"
    )
    types = {"income": "decimal(18,2)", "n": "int"}
    repaired = repair.repair_types(raw, types)
    found = {r.id: (r.income, r.n, r.failed_columns) for r in repaired.collect()}
    assert found == {
        1: (Decimal("12.50"), 3, []),
        2: (None, None, []),
        3: (None, None, ["income", "n"]),
        4: (None, 4, []),
        5: (Decimal("0.00"), None, ["n"]),
    }
    good = repair.accepted(repaired)
    assert dict(good.dtypes) == {"id": "int", "income": "decimal(18,2)", "n": "int"}
    assert sorted(r.id for r in good.collect()) == [1, 2, 4]
    bad = repair.quarantined(raw, types)
    assert {r.id: (r.income, r.failed_columns) for r in bad.collect()} == {3: ("abc", ["income", "n"]), 5: ("0", ["n"])}


def test_uncastable_blank_and_null(spark):
    df = spark.createDataFrame([("1",), ("",), ("  ",), (None,), ("x",)], "v string")
    assert sorted(r.v for r in profiling.uncastable_rows(df, "v", "decimal(18,2)").collect()) == ["", "  ", "x"]
    assert profiling.blank_count(df, "v").first()[0] == 2
    assert profiling.null_rows(df, "v").count() == 1


def test_value_range_compares_numbers_not_text(spark):
    df = spark.createDataFrame([("9",), ("10",), ("x",)], "v string")
    assert tuple(profiling.value_range(df, "v", "int").first()) == (9, 10)


def test_value_counts_shows_zero_for_null(spark):
    df = spark.createDataFrame([("Y",), ("Y",), (None,)], "v string")
    assert [tuple(r) for r in profiling.value_counts(df, "v").collect()] == [(None, 0), ("Y", 2)]


def test_value_domain_flags_the_unexpected(spark):
    df = spark.createDataFrame([("On-time",), ("Late",), (None,)], "v string")
    found = dict(profiling.value_domain(df, "v", ["ontime", "Late"]).collect())
    assert found == {"On-time": False, "Late": True, None: False}


def test_recode_keeps_the_rest(spark):
    df = spark.createDataFrame([("Y",), ("N",), ("Yes",), (None,)], "v string")
    assert [r.v for r in repair.recode(df, "v", {"Y": "Yes", "N": "No"}).collect()] == ["Yes", "No", "Yes", None]


def test_columns_added_and_dropped(spark):
    df = repair.add_columns(spark.range(1), {"d": "date", "s": "string"})
    assert dict(df.dtypes) == {"id": "bigint", "d": "date", "s": "string"}
    assert repair.drop_columns(df, "d", "s").columns == ["id"]
    with pytest.raises(ValueError):
        repair.drop_columns(df, "nope")


def test_column_types(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in profiling.column_types(df).collect()] == [("a", "int", 2), ("b", "string", 1)]


# --- duplicates ------------------------------------------------------------------


def copies(spark, n=3000):
    """A third of the rows in one group, a third without a key, the rest in small groups."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 200 + 1)
    return spark.range(n).select(key.alias("a"), F.lit("x").alias("b"), (F.lit(n) - F.col("id")).alias("order_id"))


@pytest.mark.parametrize("partitions", [None, 1, 40])
def test_numbers_equal_row_number(spark, partitions):
    df = copies(spark)
    plain = df.withColumn("row_num", F.row_number().over(Window.partitionBy("a", "b").orderBy("order_id")).cast("bigint"))
    split = duplicates.number_in_group(df, ["a", "b"], "order_id", partitions=partitions)
    assert split.columns == plain.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_numbers_by_date_and_double(spark):
    df = spark.range(300).select(
        (F.col("id") % 2).alias("k"),
        F.expr("date_add(DATE'2020-01-01', cast(id AS int))").alias("day"),
        (F.col("id") / 7).alias("x"),
    )
    for order in ("day", "x"):
        plain = df.withColumn("row_num", F.row_number().over(Window.partitionBy("k").orderBy(order)).cast("bigint"))
        split = duplicates.number_in_group(df, ["k"], order, partitions=12)
        assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_no_task_gets_a_hot_group(spark):
    df = spark.range(8000).select(F.lit(1).alias("k"), F.col("id").alias("order_id"))
    dealt = df.withColumn("_key", F.struct("k")).repartitionByRange(16, "_key", "order_id").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] <= 1500 and dealt.count() >= 12
    numbered = duplicates.number_in_group(df, ["k"], "order_id", partitions=16)
    assert numbered.agg(F.max("row_num"), F.count_distinct("row_num")).first() == (8000, 8000)


def test_flagged_and_kept_make_up_the_table(spark):
    df = copies(spark)
    keys = ["a", "b"]
    kept = duplicates.first_copies(df, keys, "order_id")
    later = duplicates.later_copies(df, keys, "order_id").drop("row_num")
    assert kept.count() == df.select(*keys).distinct().count()
    assert sorted(map(str, kept.unionByName(later).collect())) == sorted(map(str, df.collect()))


def test_parsers_beside_types(spark):
    df = spark.createDataFrame([("1", "1,234.50", "31/12/2024"), ("x", "n/a", "2024-01-01"), (" ", None, "")], "n string, price string, day string")
    readers = {"n": "int", "price": clean_number, "day": parse_day_first}
    rows = repair.repair_types(df, readers).collect()
    assert [tuple(r) for r in rows] == [
        (1, Decimal("1234.50"), datetime.date(2024, 12, 31), []),
        (None, None, None, ["n", "price", "day"]),
        (None, None, None, []),
    ]
    assert repair.quarantined(df, readers).count() == 1
