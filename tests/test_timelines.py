"""Series, hours and gaps against their plain forms."""

import datetime

import pytest
from pyspark.sql import Window, functions as F

from factsheet.operators import timelines

SERIES = "entity string, day date, value string"


def d(n):
    return datetime.date(2021, 1, n)


def part(spark):
    return spark.createDataFrame(
        [("Nigeria", d(1), "10"), ("Nigeria", d(2), "20"), ("Nigeria", d(3), ""), ("Niger", d(1), "9"), ("Asia", d(1), "1"), ("Asia", d(9), "2")], SERIES
    )


def whole(spark):
    return spark.createDataFrame(
        [("Nigeria", d(1), "4"), ("Nigeria", d(2), "0"), ("Nigeria", d(3), "8"), ("Niger", d(1), "3"), ("Asia", d(1), "x")], SERIES
    )


def test_ratio_ignores_case_and_guards_zero(spark):
    found = {r.day: r.ratio_pct for r in timelines.entity_ratio(part(spark), whole(spark), "nigeria").collect()}
    assert found == {d(1): 250.0, d(2): None, d(3): None}


def test_spread_equals_the_join_on_entity(spark):
    p = part(spark).filter(F.col("entity") == "Nigeria").select("entity", F.expr("try_cast(value AS double)").alias("a"))
    w = whole(spark).union(spark.createDataFrame([("Nigeria", d(5), "-2")], SERIES))
    pairs = w.select("entity", "day", F.expr("try_cast(value AS double)").alias("b")).join(p, "entity")
    plain = pairs.withColumn("r", F.expr("a / nullif(b, 0) * 100")).groupBy("entity", "day").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("r").alias("lo"), F.avg("r").alias("mean"), F.max("r").alias("hi")
    )
    found = timelines.entity_ratio_spread(part(spark), w, "nigeria")
    key = lambda rows: sorted((str(x) for x in rows))
    assert key(tuple(r) for r in found.select("day", "pairs", "lowest_pct", "mean_pct", "highest_pct").collect()) == key(
        tuple(r) for r in plain.select("day", "pairs", "lo", "mean", "hi").collect()
    )


def test_max_compares_numbers(spark):
    df = spark.createDataFrame([("a", d(1), "9"), ("a", d(1), "10"), ("b", d(1), "x")], SERIES)
    assert {r.entity: r.highest for r in timelines.max_by_entity_day(df).collect()} == {"a": 10.0, "b": None}
    assert timelines.max_by_entity_day(df, entities=["b"]).count() == 1


def test_strict_sum_stops_on_text(spark):
    df = spark.createDataFrame([("a", d(1), "x")], SERIES)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        timelines.sum_by_entity_day(df).collect()


def test_entity_total_equals_window(spark):
    p = part(spark).filter("value <> ''")
    w = whole(spark)
    joined = p.select("entity", "day", F.col("value").alias("part_value")).join(
        w.select("entity", "day", F.col("value").alias("whole_value")), ["entity", "day"]
    )
    plain = joined.withColumn("entity_total", F.sum(F.col("part_value").cast("double")).over(Window.partitionBy("entity")))
    found = timelines.with_entity_total(p, w)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.select(*found.columns).collect()))
    only = timelines.with_entity_total(p, w, entities=["Asia"]).collect()
    assert [(r.entity, r.entity_total) for r in only] == [("Asia", 1.0)]


TIMED = "transaction_id int, customer_id string, timestamp timestamp_ntz, is_fraud boolean"


def at(day, hour, minute=0, second=0):
    return datetime.datetime(2024, 1, day, hour, minute, second)


def test_typical_hours_ties_take_the_earlier(spark):
    rows = [(i, "a", at(1 + i, h), False) for i, h in enumerate([9, 9, 3, 5, 7])] + [(90 + i, "b", at(1, 2), False) for i in range(4)]
    df = spark.createDataFrame(rows, TIMED)
    assert {r.customer_id: r.ranked_hours for r in timelines.typical_hours(df).collect()} == {"a": [9, 3, 5, 7]}
    flags = {r.transaction_id: r.hour_flag for r in timelines.unusual_hour_flag(df).collect()}
    assert flags == {
        0: "typical_hour", 1: "typical_hour", 2: "typical_hour", 3: "typical_hour", 4: "unusual_hour",
        **{90 + i: "insufficient_history" for i in range(4)},
    }


def test_hour_of_a_missing_time(spark):
    rows = [(i, "a", at(1, 4) if i else None, False) for i in range(6)] + [(9, None, at(1, 4), False)]
    flags = {r.transaction_id: r.hour_flag for r in timelines.unusual_hour_flag(spark.createDataFrame(rows, TIMED)).collect()}
    assert flags[0] == "unusual_hour" and flags[1] == "typical_hour" and flags[9] == "insufficient_history"


def test_days_since_last_counts_midnights(spark):
    df = spark.createDataFrame(
        [
            (1, "a", at(1, 23, 59, 59), False),
            (2, "a", at(2, 0, 0, 1), False),
            (3, "a", at(2, 0, 0, 1), True),
            (4, "a", at(9, 12), False),
            (5, "b", at(9, 12), False),
            (6, "b", None, False),
            (7, None, at(3, 1), False),
            (8, None, at(4, 1), False),
        ],
        TIMED,
    )
    found = {r.transaction_id: r.days_since_last_txn for r in timelines.days_since_last(df).collect()}
    assert found == {1: None, 2: 1, 3: 0, 4: 7, 5: None, 6: None, 7: None, 8: 1}


def test_days_since_last_equals_lag(spark):
    """One customer with half of all rows, many rows at one moment."""
    df = spark.range(4000).select(
        F.col("id").cast("int").alias("transaction_id"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 37).cast("string"))).alias("customer_id"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (xxhash64(id) % 3000) * 1800)").alias("timestamp"),
    )
    order = Window.partitionBy("customer_id").orderBy("timestamp", "transaction_id")
    plain = df.withColumn("days_since_last_txn", F.datediff("timestamp", F.lag("timestamp").over(order)).cast("bigint"))
    found = timelines.days_since_last(df)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_recency_and_months(spark):
    df = spark.createDataFrame([("a", "31/12/2023"), ("a", "1/1/2024"), ("a", "2024-05-01"), ("b", "bad")], "k string, t string")
    day = F.try_to_date("t", "d/M/yyyy")
    found = {r.k: (r.last_active_date, r.days_since_last_activity) for r in timelines.recency_days(df, "k", day, "2024-01-31").collect()}
    assert found == {"a": (datetime.date(2024, 1, 1), 30), "b": (None, None)}
    assert {r.k: r.active_months for r in timelines.active_months(df, "k", day).collect()} == {"a": 2, "b": 0}
