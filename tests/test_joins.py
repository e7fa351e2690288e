"""Joins against their plain forms, with repeated, hot and missing keys."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factsheet.operators import joins
from factsheet.operators.joins import Measure


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def hot_table(spark, n=6000):
    """A third of the rows on one key, a third on none."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    return spark.range(0, n, 1, 16).select("id", key.alias("k"), F.lit("same").alias("c"))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_lookup_equals_join(spark, how, hot_rows):
    df = hot_table(spark)
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"), F.max(F.when(F.col("id") % 2 == 0, 1)).alias("even"))
    per_key = per_key.filter(F.coalesce(F.col("k") % 4 != 3, F.lit(True)))  # some keys are absent
    plain = df.join(per_key.drop("n"), "k", how).select("id", "k", "c", "top", "even")
    found = joins.lookup(df, per_key, "k", "n", how=how, hot_rows=hot_rows)
    assert found.columns == plain.columns
    assert rows(found) == rows(plain)


def test_lookup_spreads_a_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = hot_table(spark, 48000)
        per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))

        def largest_share(joined):
            sizes = joined.select("id", "top", F.spark_partition_id().alias("p")).collect()
            counts = {}
            for r in sizes:
                counts[r.p] = counts.get(r.p, 0) + 1
            return max(counts.values()) / len(sizes)

        assert largest_share(df.join(per_key, "k", "left")) > 0.33
        assert largest_share(joins.lookup(df, per_key, "k", "n", hot_rows=1000)) < 0.25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fan_tables(spark):
    left = spark.createDataFrame(
        [("a", "g1", 1, Decimal("1.50")), ("a", "g1", 2, None), ("a", "g2", None, Decimal("2.00")), ("b", "g1", 5, Decimal("4.00")),
         (None, "g3", 9, Decimal("9.00")), ("c", "g1", 7, Decimal("7.00")), ("a", None, 3, None)],
        "city string, genre string, x int, money decimal(18,2)",
    )
    right = spark.createDataFrame(
        [("a", "18-24", 21), ("a", "18-24", 21), ("a", "25-34", 29), ("b", "18-24", None), ("b", "25-34", 29), (None, "18-24", 21), ("d", "18-24", 21)],
        "city string, age string, years int",
    )
    return left, right


def test_fanout_equals_grouping_the_join(spark):
    left, right = fan_tables(spark)
    found = joins.fanout_aggregate(
        left,
        right,
        "city",
        left_by=["genre"],
        right_by=["age"],
        left_measures=[Measure("sx", "x", "sum"), Measure("mx", "x", "max"), Measure("sm", "money", "sum"), Measure("am", "money", "mean")],
        right_measures=[Measure("sy", "years", "sum"), Measure("iy", "years", "int_mean")],
    )
    plain = (
        left.join(right, "city")
        .groupBy("genre", "age")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.max("x").alias("mx"), F.sum("money").alias("sm"),
            F.avg("money").alias("am"), F.sum("years").alias("sy"), F.expr("sum(years) div count(years)").alias("iy"),
        )
    )
    def numbers(df):
        return sorted(
            (str(r.genre), r.age, *[None if r[c] is None else float(r[c]) for c in ("n", "sx", "mx", "sm", "am", "sy", "iy")])
            for r in df.collect()
        )
    assert numbers(found) == numbers(plain)


def test_fanout_rejects_unknown_measure(spark):
    left, right = fan_tables(spark)
    with pytest.raises(ValueError):
        joins.fanout_aggregate(left, right, "city", left_measures=[Measure("m", "x", "median")])


def test_fanout_count_does_not_overflow(spark):
    left = spark.sql("SELECT 'a' AS k, CAST(1 AS BIGINT) AS x")
    big = joins.fanout_aggregate(left, left, "k").select(F.col("n") * F.lit(Decimal(10) ** 18) * F.lit(Decimal(100)))
    assert big.first()[0] == Decimal(10) ** 20


def test_normalized_join(spark):
    l = spark.createDataFrame([(1, " ghana"), (2, "Togo"), (3, None)], "id int, country string")
    r = spark.createDataFrame([("Ghana ", "x"), ("TOGO", "y"), (None, "z")], "land string, v string")
    found = joins.join_on_normalized(l, r, "country", "land")
    assert found.columns == ["id", "country", "land", "v"]
    assert rows(found) == ["(1, ' ghana', 'Ghana ', 'x')", "(2, 'Togo', 'TOGO', 'y')"]


def test_absent_everywhere(spark):
    base = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    s1 = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    s2 = spark.createDataFrame([(2,), (9,)], "k int")
    assert rows(joins.absent_everywhere(base, "k", [s1, s2])) == ["(3,)", "(None,)"]


def test_sources_are_counted_by_presence(spark):
    base = spark.createDataFrame([(i,) for i in range(5)], "k int")
    money = "k int, amount decimal(18,2)"
    a = spark.createDataFrame([(0, Decimal("1.00")), (0, Decimal("2.00")), (1, Decimal("0.00")), (2, None)], money)
    b = spark.createDataFrame([(0, Decimal("5.00")), (3, Decimal("-5.00")), (9, Decimal("1.00"))], money)
    found = {r.k: (r.total_a, r.total_b, r.sources_present) for r in joins.combine_sources(base, "k", {"a": a, "b": b}).collect()}
    assert found == {
        0: (Decimal("3.00"), Decimal("5.00"), 2),
        1: (Decimal("0.00"), None, 1),
        2: (None, None, 1),
        3: (None, Decimal("-5.00"), 1),
        4: (None, None, 0),
    }


def test_tagged_sources_give_what_separate_ones_give(spark):
    base = spark.createDataFrame([(i,) for i in range(5)], "k int")
    money = "k int, source string, amount decimal(18,2)"
    data = [(0, "a", Decimal("1.00")), (0, "b", Decimal("2.00")), (1, "a", None), (2, None, Decimal("7.00")), (9, "b", Decimal("1.00"))]
    tagged = spark.createDataFrame(data, money)
    apart = {n: tagged.filter(F.col("source") == n).select("k", "amount") for n in ("a", "b")}
    found = joins.combine_sources(base, "k", joins.Tagged(tagged, ("a", "b")))
    assert rows(found) == rows(joins.combine_sources(base, "k", apart))
    assert {r.k: r.sources_present for r in found.collect()} == {0: 2, 1: 1, 2: 0, 3: 0, 4: 0}
