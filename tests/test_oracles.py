import pytest
from granary.plans import ORACLES, QUERIES

from .conftest import DATA, rows_of_spark


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(same, name):
    assert same(QUERIES[name], ORACLES[name]) is not None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs_and_has_rows(spark, name):
    cols, rows = rows_of_spark(QUERIES[name](spark, DATA))
    assert cols and rows


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
