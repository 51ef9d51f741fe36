"""Every query with SQL against DuckDB; every other one runs and keeps its columns."""

import pytest

from helixframe.plans.registry import ORACLE, QUERIES
from tests.conftest import DATA, same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(name, spark, duck):
    same(QUERIES[name](spark, str(DATA)), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(name, spark):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
