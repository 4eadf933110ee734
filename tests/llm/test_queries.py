from pathlib import Path

import pytest

from oracle import compare, connect
from tracewell.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    ok, said = compare(spark, SF, name, connect(SF), queries.QUERIES, queries.SQL)
    assert ok, said
