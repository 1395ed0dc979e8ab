"""Every query of this package against its SQL, or that it gives rows."""

import os

import pytest

from lexquarry.llm import queries as Q
from lexquarry.plans.session import ship
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    ship(spark)
    df = Q.QUERIES[name](spark, SF)
    if name in Q.SQL:
        n, why = compare(df, con, Q.SQL[name])
        assert not why, why
    else:
        assert df.count() > 0
