import pytest

from tessera import catalog
from tests.conftest import SMALL
from tests.oracle import same_rows


def test_every_query_has_its_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLES[name], SMALL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_filters_reach_the_scan(spark):
    """The literal that a match needs is tested before texts are split, and only two columns are read."""
    plan = catalog.QUERIES["search_literal"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Contains" in plan or "StringContains" in plan
    assert "n_chars" not in plan and "BatchEvalPython" not in plan
