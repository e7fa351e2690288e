"""Every query against its SQL on the same tables: names, types and exact values."""

import os

import pytest

import __spark_entry__ as contract
from factsheet.plans import catalog
import compare

FOLDER = os.environ.get("FACTSHEET_TEST_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, con, name):
    sql = contract.oracle_sql()[name]
    df = contract.queries()[name](spark, FOLDER)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types == {k: compare.SAME_TYPE.get(v, v) for k, v in compare.oracle_types(con, sql).items()}
    names, got = compare.spark_rows(df)
    expected_names, expected = compare.oracle_rows(con, sql)
    assert names == expected_names
    assert len(got) == len(expected)
    assert got == expected
    if FOLDER.endswith("sf0.01"):  # bounds in the queries are fitted to this size
        assert got, "an empty result checks nothing"


def test_entry(spark):
    assert contract.entry(spark).count() > 0
