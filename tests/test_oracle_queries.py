"""Every registered query against its DuckDB oracle on the sf0.01 tables (exact match)."""

import pytest

import __spark_entry__ as E
from meterbook.plans import catalog
from tests.conftest import SF001, SF01
from tests.helpers import compare

QUERIES = E.queries()
SQL = E.oracle_sql()


def test_every_report_query_has_an_oracle():
    assert set(SQL) <= set(QUERIES)
    assert set(catalog.QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck_sf01, name):
    df = QUERIES[name](spark, SF01)
    assert compare(df, duck_sf01.sql(SQL[name])) == []


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "total_vat_inc_raw" in df.columns


def test_queries_run_at_smallest_scale(spark):
    for name, fn in catalog.QUERIES.items():
        assert fn(spark, SF001).schema is not None, name
