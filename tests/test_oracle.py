"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle_check
import standins

# Queries of subpackages are tested beside them.
QUERIES = {name: build for name, build in entry.queries().items() if name in standins.QUERIES}
SQL = standins.SQL


@pytest.fixture(scope="module")
def con(sf):
    return oracle_check.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    assert oracle_check.compare(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["s", "total_score", "variant_count", "zscore", "percentile", "risk_category"]
    assert df.count() > 0


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)
