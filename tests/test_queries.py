"""Every query of the core against its SQL; those without SQL must run."""

import pytest

from strata.plans import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, DATA).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
