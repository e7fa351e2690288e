"""Sorted queries against their SQL, row by row in order; and where NULL goes."""

import pytest

import compare
from factsheet.operators import ordering
from factsheet.plans import catalog

FOLDER = "/root/testdata/sf0.01"
SORTED = ["sort_asc", "sort_desc", "sort_multi", "sort_alias", "sort_ordinal", "sort_hidden_key", "customer_tiers"]


@pytest.mark.parametrize("name", SORTED)
def test_rows_come_in_order(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    cursor = compare.connect(FOLDER).execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert [tuple(compare._cell(v) for v in r) for r in df.select(*names).collect()] == [tuple(compare._cell(v) for v in r) for r in cursor.fetchall()]


def test_order_of_null(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 5), (5, None)], "id int, v int")
    ids = lambda *keys: [r.id for r in ordering.sort_rows(df, *keys, unique="id").collect()]
    assert ids("v") == [2, 5, 1, 4, 3]
    assert ids(ordering.nulls_highest("v")) == [1, 4, 3, 2, 5]
    assert ids(ordering.nulls_highest("v", descending=True)) == [2, 5, 3, 1, 4]
