"""Queries of the text operators against their SQL."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from stillhouse.llm.oracle import ORACLE
from stillhouse.llm.queries import QUERIES


@pytest.fixture(scope="module")
def sql(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf_dir, sql, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLE[name], sql) == []


def test_all_operators_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}


def test_queries_after_the_teachers_were_called(spark, sf_dir):
    """What is sent along with the teachers' tasks doesn't change how these queries reach the workers."""
    from stillhouse.plans.queries import QUERIES as OTHERS

    assert OTHERS["complete_with_retries"](spark, sf_dir).count() > 0
    for name in ("op6_warc", "op11_source_divergence", "op13_conversation_repair"):
        assert QUERIES[name](spark, sf_dir).count() > 0
