"""Every query that has SQL gives the same rows as DuckDB on the small tables."""

import pytest

from changelens import plans
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = rows(plans.queries()[name](spark, sf))
    assert got == rows(duck.sql(plans.oracle_sql()[name]).df())


def test_queries_without_sql_have_rows(spark, sf):
    """Their operators are tested by hand in test_graph and test_changes; here they give rows, the same ones each time."""
    for name in sorted(set(plans.queries()) - set(plans.oracle_sql())):
        got = rows(plans.queries()[name](spark, sf))
        assert got[1] and got == rows(plans.queries()[name](spark, sf)), name


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "via_kind" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
