"""Queries of the subpackage against their SQL."""

import pytest

from strata.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark):
    assert queries.QUERIES[name](spark, DATA).count() > 0
