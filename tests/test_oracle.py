"""Every query of the pack against its SQL."""

import pytest

from tests.oracle import difference
from tributary.plans import workloads  # noqa: F401  (adds to the pack)
from tributary.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLES:
        extra, lost, _ = difference(spark, sf, QUERIES[name], ORACLES[name])
        assert not extra and not lost, (extra, lost)
    else:
        assert QUERIES[name](spark, sf).count() >= 0
