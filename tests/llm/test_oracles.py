"""Every query that has SQL gives the same rows as the SQL, on whole tables."""

import pytest

from seqlab.llm.queries import ORACLES, QUERIES
from tests.compare import difference, duck
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None
