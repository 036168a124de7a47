"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest
from oracle import compare
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert (said := compare(spark, name, catalog.queries()[name], SQL[name], SF)) is None or said.startswith("exact"), said


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
