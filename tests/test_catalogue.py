"""Every query of the catalogue against its SQL, and the contract of the entry point."""

import pytest

import __spark_entry__ as contract
from gaugeworks.plans import catalogue, runs  # noqa: F401 runs adds its queries to the catalogue's


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf, same, name):
    same(catalogue.QUERIES[name](spark, sf), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_without_sql(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert set(catalogue.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["eer", "threshold"]


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalogue.QUERIES["restrict_identities_semi"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThan(s_acctbal,5000" in plan
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan
