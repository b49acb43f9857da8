"""The reference's own operators: every query against its SQL, and required cases."""

from __future__ import annotations

import pytest
from loomspark.plans import outside

SF = "/root/testdata/sf0.001"
QUERIES, SQL = outside.queries(), outside.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_is_stable(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and df.schema == entry.entry(spark).schema
    assert set(entry.oracle_sql()) <= set(entry.queries())
