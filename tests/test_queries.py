"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 15 * 30


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    result = QUERIES[name](spark, FOLDER).toPandas()
    assert len(result)
    if name in ORACLES:
        assert difference(result, database.sql(ORACLES[name]).df()) is None
