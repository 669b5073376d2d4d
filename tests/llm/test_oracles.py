"""The queries that have SQL, against it."""

import pytest

from tests.oracle import difference
from tributary.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    extra, lost, n = difference(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLES[name])
    assert not extra and not lost and n, (extra, lost)
