"""Every query against its SQL."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from stillhouse.plans.queries import QUERIES


@pytest.fixture(scope="module")
def sql(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, sql, name):
    frame = entry_points.queries()[name](spark, sf_dir)
    assert differences(frame, entry_points.oracle_sql()[name], sql) == []


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.oracle_sql())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 5
