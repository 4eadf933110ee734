"""Every query with an SQL twin gives the same rows on the smallest tables."""

from pathlib import Path

import pytest

from oracle import compare, connect
from tracewell.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    ok, said = compare(spark, SF, name, con, registry.QUERIES, registry.SQL)
    assert ok, said
