"""Every registered query against its SQL on the smallest data."""

import pytest

from checks.compare import connect, rows_of_spark, rows_of_sql
from checks.oracle import build
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
ORACLE = build()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_registered():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, got = rows_of_spark(QUERIES[name](spark, SF))
    sql_columns, want = rows_of_sql(con, ORACLE[name])
    assert columns == sql_columns
    assert got == want
