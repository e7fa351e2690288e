"""Shape of the plans: what reaches the scan, what is shuffled, and what is not there."""

import re

import pytest

import __spark_entry__ as contract
from factsheet.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan(spark):
    def of(name, run=False):
        df = contract.queries()[name](spark, FOLDER)
        if run:
            df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    return of


# A bounded number of rows arrives at the single task of a global aggregate or a limit;
# a window or sort in one task would take the whole table.
ONE_TASK = re.compile(r"(Window|Sort)[^\n]*\n[^\n]*Exchange SinglePartition")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_whole_table_in_one_task(plan, name):
    text = plan(name)
    assert not ONE_TASK.search(text)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark, plan, capsys):
    contract.queries()["filter_conj"](spark, FOLDER).explain("formatted")
    text = capsys.readouterr().out
    assert "EqualTo(p_type,ECONOMY)" in text and "GreaterThan(p_size,25)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan("scan_columns")
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan("rate_by_flag")


def test_one_shuffle_for_a_rate(plan):
    assert plan("rate_by_flag").count("Exchange") == 1


def test_four_sources_take_one_shuffle(plan):
    assert plan("source_totals").count("Exchange") == 1


def test_top_n_does_not_sort_the_table(plan):
    assert "TakeOrderedAndProject" in plan("top_n")


def test_copies_are_dropped_before_the_shuffle(plan):
    assert "Partial" in plan("dedupe_keep") and "WindowGroupLimit" in plan("dedupe_keep")


def test_absence_is_an_anti_join(plan):
    assert "LeftAnti" in plan("zero_activity")


def test_scaling_reads_the_sources_once(plan):
    text = plan("minmax_scale", run=True)
    assert "ReusedExchange" in text and "Window" not in text


def test_no_rows_are_paired_for_the_preview(plan):
    assert "Window" not in plan("self_join_fill_preview")


def test_lookup_keeps_the_place_in_the_join_key(spark):
    from pyspark.sql import functions as F

    from factsheet.operators.joins import lookup

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select("id", (F.col("id") % 5).alias("k"))
        per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        text = lookup(df, per_key, "k", "n")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(k#\d+L, _place#\d+", text)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
