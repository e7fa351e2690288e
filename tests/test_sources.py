"""Readers, typed tables, stored results and exports."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from factsheet.sources import ingest, publish


def test_quoted_header_is_one_column(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        'Entity,Day,"Daily deaths (rolling 7-day average, right-aligned)"\nAsia,2021-01-01,"1,5"\n"A ""B"" C",2021-01-02,\n'
    )
    df = ingest.read_text_table(spark, str(tmp_path / "d.csv"), ["entity", "day", "deaths"])
    assert dict(df.dtypes) == {"entity": "string", "day": "string", "deaths": "string"}
    assert [tuple(r) for r in df.collect()] == [("Asia", "2021-01-01", "1,5"), ('A "B" C', "2021-01-02", None)]


def test_names_are_cleaned(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["UniqueID ", "Vaccine doses (per 100)", "uniqueid", "%"])
    assert ingest.with_clean_names(df).columns == ["uniqueid", "vaccine_doses_per_100", "uniqueid_2", "column"]


def test_typed_table_goes_by_position_and_is_strict(spark):
    schema = StructType([StructField("entity", StringType()), StructField("n", IntegerType()), StructField("x", DoubleType())])
    rows = spark.createDataFrame([("a", "1", "2.5")], "x string, entity string, n string")
    typed = publish.typed_table(rows, schema, view="typed_test")
    assert typed.schema.simpleString() == schema.simpleString()
    assert tuple(spark.table("typed_test").first()) == ("a", 1, 2.5)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        publish.typed_table(rows.withColumn("entity", F.lit("one")), schema)
    with pytest.raises(ValueError):
        publish.typed_table(rows.drop("n"), schema)


def test_stored_result_is_read_not_computed(spark, tmp_path):
    df = spark.range(10).withColumn("d", F.lit(datetime.date(2024, 1, 1)))
    plan = publish.materialize(df, view="stored_test")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "Range" not in plan
    written = publish.materialize(df, path=str(tmp_path / "t"))
    assert "FileScan parquet" in written._jdf.queryExecution().executedPlan().toString()
    assert spark.table("stored_test").count() == 10


class FakeSession:
    """As much of a session as the choice of a folder looks at."""

    def __init__(self, master, conf_folder=None, context_folder=None):
        self.conf = {} if conf_folder is None else {"spark.checkpoint.dir": conf_folder}
        self.sparkContext = self
        self.master = master
        self.folder = context_folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_folder_comes_from_the_session(tmp_path):
    assert publish.fresh_path(FakeSession("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert publish.shared_folder(FakeSession("yarn", None, "hdfs:///set")) == "hdfs:///set"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        publish.shared_folder(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert publish.shared_folder(local) == publish.shared_folder(local) == local.folder


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a, b", 1.5), ('say "x"', None)], "s string, x double")
    path = publish.export(df, str(tmp_path / "out"), fmt, one_file=True)
    back = spark.read.schema(df.schema).format(fmt).options(header=True, escape='"').load(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        publish.export(df, path, "xlsx")


def test_view_computes_nothing(spark):
    publish.saved_view(spark.range(3).withColumn("x", F.col("id") * 2), "view_test")
    assert spark.sql("SELECT max(x) FROM view_test").first()[0] == 4


def test_one_file_only_for_few_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        publish.export(spark.range(11), str(tmp_path / "few"), one_file=True, most_rows=10)


def test_repeated_names_stay_apart(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "a ", "a 2"])
    assert ingest.with_clean_names(df).columns == ["a", "a_3", "a_2"]
