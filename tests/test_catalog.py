"""Every registered query beside its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in entry.oracle_sql():
        assert compare(df, con, entry.oracle_sql()[name]) == []
    else:
        assert df.count() >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
