"""Appends by position, checked publishes and views of the catalog."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, StringType, StructField, StructType

from factsheet.sources import publish
from factsheet.sources.publish import Expectation, append_typed, checked_publish

SCHEMA = StructType([StructField("name", StringType()), StructField("n", IntegerType()), StructField("x", DecimalType(6, 2))])


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, c string")


@pytest.fixture(params=["path", "table"])
def target(request, spark, tmp_path):
    if request.param == "path":
        return {"path": str(tmp_path / "t")}
    name = f"t_{uuid.uuid4().hex}"
    location = str(tmp_path / "warehouse_t")
    spark.sql(f"CREATE TABLE {name} (name STRING, n INT, x DECIMAL(6,2), _batch STRING) USING parquet PARTITIONED BY (_batch) LOCATION '{location}'")
    request.addfinalizer(lambda: spark.sql(f"DROP TABLE {name}"))
    return {"table": name}


def test_batches_add_up_and_repeat_once(spark, target):
    one, two = frame(spark, [("a", "1", "1.005"), (None, None, None)]), frame(spark, [("b", " 2", "3")])
    append_typed(one, SCHEMA, "2020-01-01", **target)
    append_typed(two, SCHEMA, "7", **target)
    found = append_typed(one, SCHEMA, "2020-01-01", **target)
    assert [(f.name, f.dataType) for f in found.schema.fields] == [(f.name, f.dataType) for f in SCHEMA.fields]
    assert sorted(map(str, map(tuple, found.collect()))) == ["('a', 1, Decimal('1.01'))", "('b', 2, Decimal('3.00'))", "(None, None, None)"]
    replaced = append_typed(frame(spark, [("c", "3", "4")]), SCHEMA, "7", **target)
    assert sorted(r.name or "" for r in replaced.collect()) == ["", "a", "c"]
    assert append_typed(one.limit(0), SCHEMA, "7", **target).count() == 3


def test_a_write_that_fails_leaves_the_table(spark, target):
    append_typed(frame(spark, [("a", "1", "1")]), SCHEMA, "1", **target)
    for bad in ([("a", "x", "1")], [("a", "1", "123456789")]):
        with pytest.raises(PySparkException):
            append_typed(frame(spark, bad), SCHEMA, "1", **target)
    assert append_typed(frame(spark, []), SCHEMA, "2", **target).collect() == [("a", 1, 1)]


def test_shape_is_checked_before_the_write(spark, target):
    rows = frame(spark, [("a", "1", "1")])
    append_typed(rows, SCHEMA, "1", **target)
    with pytest.raises(ValueError, match="2 columns for 3"):
        append_typed(rows.drop("c"), SCHEMA, "2", **target)
    with pytest.raises(ValueError, match="cannot be cast"):
        append_typed(rows.withColumn("b", F.array("b")), SCHEMA, "2", **target)
    other = StructType([*SCHEMA.fields[:2], StructField("x", StringType())])
    with pytest.raises(ValueError, match="the table has"):
        append_typed(rows, other, "2", **target)
    with pytest.raises(ValueError, match="batch"):
        append_typed(rows, SCHEMA, "", **target)
    with pytest.raises(ValueError, match="path or a table"):
        append_typed(rows, SCHEMA, "1")
    assert append_typed(rows, SCHEMA, "1", **target).count() == 1


# --- expectations -------------------------------------------------------------------


def people(spark):
    return spark.createDataFrame([(1, "a", 5), (2, None, -1), (3, "c", None), (4, "d", 7)], "id int, name string, n int")


def test_counts_and_rows_put_aside(spark, tmp_path):
    named = Expectation("named", F.col("name").isNotNull())
    positive = Expectation("positive", F.col("n") > 0, refuse=True, most=2)
    found = checked_publish(people(spark), [named, positive], str(tmp_path), view="checked_people")
    assert (found.rows, dict(found.failed)) == (4, {"named": 1, "positive": 2})
    assert sorted(r.id for r in found.table().collect()) == [1, 3, 4] == sorted(r.id for r in spark.table("checked_people").collect())
    assert [r.id for r in found.set_aside().collect()] == [2] and found.table().columns == ["id", "name", "n"]
    assert sorted(map(tuple, found.report().collect())) == [("named", 1, 4), ("positive", 2, 4)]


def test_a_refusal_leaves_what_is_published(spark, tmp_path):
    good = people(spark).filter("n > 0")
    rule = [Expectation("positive", F.col("n") > 0, refuse=True)]
    checked_publish(good, rule, str(tmp_path), view="kept_people")
    with pytest.raises(publish.Refused) as error:
        checked_publish(people(spark), rule, str(tmp_path), view="kept_people")
    assert error.value.failed == {"positive": 2} and error.value.rows == 4
    assert spark.table("kept_people").count() == 2


def test_no_rows_no_expectations_and_equal_names(spark, tmp_path):
    rule = Expectation("positive", F.col("n") > 0, refuse=True)
    empty = checked_publish(people(spark).limit(0), [rule], str(tmp_path))
    assert (empty.rows, dict(empty.failed), empty.table().count(), empty.set_aside().count()) == (0, {"positive": 0}, 0, 0)
    assert checked_publish(people(spark), [], str(tmp_path)).table().count() == 4
    with pytest.raises(ValueError):
        checked_publish(people(spark), [rule, rule], str(tmp_path))


def test_the_source_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = people(spark).mapInArrow(count, "id int, name string, n int")
    rules = [Expectation(f"rule {i}", F.col("n") > i) for i in range(20)]
    checked_publish(source, rules, str(tmp_path))
    assert seen.value == 4


# --- views of the catalog -----------------------------------------------------------


def test_a_view_is_replaced_and_read_by_other_sessions(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "people"))
    people(spark).limit(1).write.parquet(str(tmp_path / "other"))
    publish.catalog_table(spark, "view_people", str(tmp_path / "people"))
    assert publish.catalog_view(spark, "people_view", "SELECT id FROM view_people WHERE n > 0").count() == 2
    assert publish.catalog_view(spark, "people_view", "SELECT COUNT(*) AS n FROM view_people").collect() == [(4,)]
    assert spark.newSession().table("people_view").collect() == [(4,)]
    publish.catalog_table(spark, "view_people", str(tmp_path / "other"))
    publish.catalog_table(spark, "view_people", str(tmp_path / "other"))
    assert spark.table("people_view").collect() == [(1,)]
    people(spark).createOrReplaceTempView("passing")
    with pytest.raises(PySparkException):
        publish.catalog_view(spark, "people_view", "SELECT * FROM passing")
    spark.sql("DROP VIEW people_view")
    spark.sql("DROP TABLE view_people")
