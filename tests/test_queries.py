"""Every registered query against its SQL at the smallest scale."""

import pytest

from checks import compare, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


def test_entry(spark, con):
    import __spark_entry__ as e
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    (expected,) = con.execute(f"SELECT count(*) FROM ({registry.oracle_sql()['plan']})").fetchone()
    assert e.entry(spark).count() == expected > 0
