"""Every registered query of the subpackage that has SQL, against it, on whole tables."""

import pytest
from oracle import compare, connect

from cloudgrain.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SF) is None
