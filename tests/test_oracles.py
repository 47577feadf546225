"""Every query with SQL gives what the SQL gives."""

import pytest

from lodestar import plans
from lodestar.registry import REGISTRY
from tests.oracle import assert_same

plans.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, name):
    result = REGISTRY.queries[name](spark, SF)
    if name in REGISTRY.oracles:
        assert_same(result, REGISTRY.oracles[name], SF)
    else:
        assert result.columns and result.count() >= 0
