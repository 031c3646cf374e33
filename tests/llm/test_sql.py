"""Every registered query that SQL can express, against its SQL at the smallest scale."""

import pytest

from checks import compare
from hopsight.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare.differences(registry.queries()[name](spark, SF), compare.connect(SF), registry.oracle_sql()[name]) == ""


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.queries()) == list(range(1, 14))
