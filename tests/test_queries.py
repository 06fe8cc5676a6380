import os

import oracle
import pytest

from sessionlake.plans import queries as plans

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(plans.SQL))
def test_matches_oracle(spark, con, name):
    assert oracle.compare(plans.QUERIES[name](spark, SF), con, plans.SQL[name]) is None
