"""Core queries against their SQL."""

import pytest
from oracle import assert_equal

from scriptoria import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, data, name):
    assert_equal(spark, data, queries.QUERIES[name], queries.SQL[name])
