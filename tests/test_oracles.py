"""Every registered query against its DuckDB twin, or, without one, that it runs with a stable schema."""

import pytest

import oracle
from auditlake import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert oracle.differences(spark, name, QUERIES, ORACLES) == ""


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
