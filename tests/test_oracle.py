"""Every store query against DuckDB on the same tables."""

import pytest
from tables import SF, rows

from stratalake.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toArrow()
    want = duck.sql(plans.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
