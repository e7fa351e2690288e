"""Running figures over hot groups that are cut into ranges, against plain windows."""

import datetime

import pytest
from pyspark.sql import Window, functions as F

from factsheet.operators import duplicates, scoring, timelines
from factsheet.operators.ranges import Running, accumulate, ranges

CUT = {"share": 16, "hot_rows": 0}


def uneven(spark, n=3000):
    """A third of the rows in one group, a third without a key, the rest in small groups; ``x`` repeats and is NULL at times."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 200 + 1)
    mixed = (F.col("id") * 7919) % n
    return spark.range(n).select(key.alias("k"), F.col("id"), F.when(mixed % 11 != 0, (mixed / 4).cast("int")).alias("x"), (mixed % 5).alias("v"))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["int", "double", "decimal(9,2)", "string", "date", "timestamp_ntz", "timestamp"])
def test_sums_equal_a_window(spark, kind, descending):
    x = F.col("x")
    x = F.date_add(F.lit(datetime.date(2020, 1, 1)), x).cast(kind) if kind.startswith(("date", "timestamp")) else x.cast(kind)
    df = uneven(spark).withColumn("x", x)
    order = F.desc("x") if descending else F.asc("x")
    plain = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy(order)))
    split = accumulate(df, ["k"], "x", [Running("s", F.col("v"))], descending=descending, **CUT)
    assert split.columns == plain.columns and rows(split) == rows(plain)
    assert rows(accumulate(df, ["k"], "x", [Running("s", F.col("v"))], descending=descending)) == rows(plain)


def test_other_folds_and_several_keys(spark):
    df = uneven(spark).withColumn("b", F.lit("x"))
    window = Window.partitionBy("k", "b").orderBy("id")
    plain = df.withColumn("m", F.max("v").over(window)).withColumn("h", F.bit_xor(F.xxhash64("id")).over(window))
    figures = [Running("m", F.col("v"), F.max, F.greatest), Running("h", F.xxhash64("id"), F.bit_xor, lambda a, b: a.bitwiseXOR(b))]
    assert rows(accumulate(df, ["k", "b"], "id", figures, **CUT)) == rows(plain)


def test_ranges_cut_a_hot_group_evenly(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    cut = ranges(df, ["k"], "x", **CUT)
    sizes = cut.apply(df).filter("_range IS NOT NULL").groupBy("_range").count().toPandas()["count"]
    assert sizes.sum() == 13_334 and len(sizes) >= 4 and sizes.max() < 2.5 * 40_000 / 16
    assert not ranges(df.limit(0), ["k"], "x", **CUT).hot
    assert not ranges(df, ["k"], "x").hot


def test_no_task_gets_a_hot_group(spark):
    df = spark.range(8000).select((F.col("id") >= 0).alias("k"), F.col("id").alias("x"))
    numbered = accumulate(df, ["k"], "x", [Running("n", F.lit(1))], share=16, hot_rows=0)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_range" in plan.split("hashpartitioning(k")[1][:40]
    cut = ranges(df, ["k"], "x", **CUT)
    assert cut.apply(df).groupBy("_range").count().agg(F.max("count")).first()[0] < 1500
    assert numbered.agg(F.max("n"), F.count_distinct("n")).first() == (8000, 8000)


def test_numbering_takes_one_shuffle_of_the_rows(spark):
    df = uneven(spark)
    plan = duplicates.number_in_group(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Scan ExistingRDD" not in plan


# --- ranks of scores of any type ---------------------------------------------------


@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(20,4)", "string", "float"])
def test_rank_of_wide_scores(spark, kind):
    df = uneven(spark).withColumn("x", F.col("x").cast(kind))
    plain = df.withColumn("rank_within_group", F.rank().over(Window.partitionBy("k").orderBy(F.desc_nulls_last("x"))).cast("bigint"))
    for cut in ({}, CUT):
        ranked = scoring.rank_any(df, "k", "x", **cut)
        assert rows(ranked) == rows(plain)


def test_one_score_of_all_rows_and_no_rows(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.lit(1.5).alias("s"))
    ranked = scoring.rank_any(df, "g", "s", **CUT)
    assert ranked.groupBy("rank_within_group").count().collect() == [(1, 5000)]
    assert scoring.rank_any(df.limit(0), "g", "s").count() == 0


# --- running totals ----------------------------------------------------------------


def test_running_total_of_a_hot_entity(spark):
    df = uneven(spark).select(F.col("k").alias("entity"), F.date_add(F.lit(datetime.date(2020, 1, 1)), F.col("x")).alias("day"), F.col("v").alias("value"))
    plain = df.withColumn("running_total", F.sum(F.col("value").cast("bigint")).over(Window.partitionBy("entity").orderBy("day")))
    for cut in ({}, CUT):
        assert rows(timelines.running_total(df, "value", as_type="bigint", **cut)) == rows(plain)


def test_running_total_of_one_hot_day_nulls_and_no_rows(spark):
    schema = "entity string, day string, value double"
    df = spark.createDataFrame([("a", "1", None), ("a", "1", None), ("a", "2", 3.0), ("a", "3", None), ("a", None, 1.0), (None, "1", 2.0)], schema)
    found = {(r.entity, r.day): r.running_total for r in timelines.running_total(df, "value").collect()}
    assert found == {("a", None): 1.0, ("a", "1"): 1.0, ("a", "2"): 4.0, ("a", "3"): 4.0, (None, "1"): 2.0}
    one_day = spark.range(4000).select(F.lit("a").alias("entity"), F.lit("1").alias("day"), F.lit(1.0).alias("value"))
    assert timelines.running_total(one_day, "value", **CUT).groupBy("running_total").count().collect() == [(4000.0, 4000)]
    assert timelines.running_total(df.limit(0), "value").count() == 0
