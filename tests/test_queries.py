"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    difference = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert difference is None, difference


def test_entry_gives_one_row_per_class(spark):
    got = entry.entry(spark)
    assert got.columns == ["class_id", "name", "train", "valid", "test", "total"]
    assert got.count() == 62
