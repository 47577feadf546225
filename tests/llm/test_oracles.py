"""Queries of the subpackage against their SQL."""

import pytest

from lodestar.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)
