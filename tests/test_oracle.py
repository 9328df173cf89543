"""Every registered query against its SQL on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import canonical, connect, type_differences
from workload.oracle import oracle_statements
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == oracle_statements().keys()
    assert queries().keys() >= oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    df = queries()[name](spark, SF_DIR)
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(oracle_sql()[name])
    wanted = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert found == wanted
    assert not type_differences(df, cursor.description)


def test_entry_has_rows(spark):
    assert entry(spark).count() == 4
