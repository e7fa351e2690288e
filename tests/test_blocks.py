"""Joins of reduced sides in blocks, comparison without case, and the check of bands."""

import pytest
from pyspark.sql import functions as F

from factsheet.functions import text
from factsheet.operators import joins, segments, summaries


def sides(spark, n=2000):
    """Key 0 has ``n`` groups on both sides, others a few; some have no key or stand on one side only."""

    def side(name, seed):
        hot = spark.range(n).select(F.lit(0).alias("k"), (F.col("id") + seed).alias(name))
        rest = spark.range(300).select((F.col("id") % 60 + 1 + seed % 7).alias("k"), F.col("id").alias(name))
        none = spark.range(3).select(F.lit(None).cast("int").alias("k"), F.col("id").alias(name))
        return hot.unionByName(rest).unionByName(none).withColumn(f"{name}_value", F.xxhash64(name) % 100)

    return side("a", 3), side("b", 5)


def test_blocks_make_every_pair_once(spark):
    left, right = sides(spark, 90)
    plain = left.join(right, "k")
    for block in (7, 1000):
        split = joins.in_blocks(left, right, "k", ["a"], ["b"], block=block)
        assert sorted(split.columns) == sorted(plain.columns)
        assert sorted(map(str, split.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert joins.in_blocks(left.limit(0), right, "k", ["a"], ["b"]).count() == 0


def test_pairs_of_one_key_are_spread_over_tasks(spark):
    left, right = sides(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        reduced = [x.groupBy("k", n).agg(F.sum(f"{n}_value").alias(f"{n}_value")) for x, n in ((left, "a"), (right, "b"))]
        for block, least in ((200, 25), (10**6, 1)):
            pairs = joins.in_blocks(*reduced, "k", ["a"], ["b"], block=block).filter("k = 0").groupBy(F.spark_partition_id()).count().toPandas()["count"]
            assert pairs.sum() == 2000 * 2000
            assert len(pairs) >= least and (block > 2000 or pairs.max() < 0.2 * pairs.sum())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fanout_in_blocks_equals_the_full_join(spark):
    left, right = sides(spark, 60)
    plain = left.join(right, "k").groupBy((F.col("a") % 9).alias("g"), (F.col("b") % 4).alias("h")).agg(F.count("*").alias("n"), F.sum("a_value").alias("s"), F.max("b_value").alias("m"))
    l, r = left.withColumn("g", F.col("a") % 9), right.withColumn("h", F.col("b") % 4)
    measures = {"left_measures": [joins.Measure("s", "a_value", "sum")], "right_measures": [joins.Measure("m", "b_value", "max")]}
    found = joins.fanout_aggregate(l, r, "k", left_by=["g"], right_by=["h"], block=2, **measures)
    assert sorted(tuple(map(int, x)) for x in found.select("g", "h", "n", "s", "m").collect()) == sorted(tuple(map(int, x)) for x in plain.collect())


# --- without case -------------------------------------------------------------------


def test_comparison_without_case(spark):
    df = spark.createDataFrame([("Ab", 1), ("aB", 2), ("b", 3), (None, 4), ("É", 5), ("é", 6)], "t string, n int")
    assert sorted(r.n for r in df.filter(text.ignoring_case("t") == "AB").collect()) == [1, 2]
    assert sorted(r.n for r in df.filter(text.isin_ignoring_case("t", ["AB", "x", "é"])).collect()) == [1, 2, 5, 6]
    assert df.filter(text.isin_ignoring_case("t", [])).count() == 0
    grouped = summaries.group_ignoring_case(df, "t", F.sum("n").alias("n"))
    assert sorted(map(str, map(tuple, grouped.collect()))) == ["('Ab', 3)", "('b', 3)", "('É', 11)", "(None, 4)"]
    assert grouped.schema["t"].dataType.simpleString() == "string"
    other = spark.createDataFrame([("AB", "x"), ("B", "y"), (None, "z")], "u string, v string")
    joined = joins.join_ignoring_case(df, other, "t", "u")
    assert sorted((r.n, r.t, r.u, r.v) for r in joined.collect()) == [(1, "Ab", "AB", "x"), (2, "aB", "AB", "x"), (3, "b", "B", "y")]
    assert joins.join_ignoring_case(df, other, "t", "u", "left").count() == 6


def test_a_join_without_case_is_no_nested_loop(spark):
    df = spark.createDataFrame([("Ab",)], "t string")
    plan = joins.join_ignoring_case(df, df.withColumnRenamed("t", "u"), "t", "u")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- bands --------------------------------------------------------------------------

BANDS = {
    "rising": [1.0, 2.0, 5.0],
    "falling": [5.0, 2.0, 1.0],
    "not falling": [1.0, 1.0, 2.0],
    "not rising": [2.0, 1.0, 1.0],
    "level": [3.0, 3.0],
    "mixed": [1.0, 3.0, 2.0],
    "too few": [4.0],
}


@pytest.mark.parametrize("verdict", BANDS)
def test_verdicts(spark, verdict):
    df = spark.createDataFrame([(i, r, 100) for i, r in enumerate(BANDS[verdict])], "band int, rate double, n long")
    found = segments.monotone(df, "band", "rate", "n").orderBy("band").collect()
    assert {r.verdict for r in found} == {verdict}
    rates = BANDS[verdict]
    assert [r.change for r in found] == [None, *[b - a for a, b in zip(rates, rates[1:])]]


def test_small_bands_and_groups(spark):
    rows = [("x", 0, 1.0, 30), ("x", 1, 9.0, 29), ("x", 2, 2.0, 50), ("x", 3, None, 90), ("y", 0, 2.0, 40), ("y", 1, 1.0, 40), ("z", 0, 1.0, 5)]
    df = spark.createDataFrame(rows, "g string, band int, rate double, n long")
    found = {(r.g, r.band): r for r in segments.monotone(df, "band", "rate", "n", by=["g"]).collect()}
    assert [found["x", i].reliable for i in range(4)] == [True, False, True, False]
    assert [found["x", i].change for i in range(4)] == [None, None, 1.0, None]
    assert {g: found[g, 0].verdict for g in "xyz"} == {"x": "rising", "y": "falling", "z": "too few"}
    assert segments.monotone(df.limit(0), "band", "rate", "n").count() == 0
