"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import os

import pytest
from tools_compare import compare

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    assert compare(spark, SMALL, name)


def test_entry_has_rows():
    assert set(entry.oracle_sql()) <= set(entry.queries())
