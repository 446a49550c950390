"""Every registered query with a DuckDB twin, on the smallest tables."""

import pytest

from check_oracle import compare, connect
from trustframe.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf, con, name):
    message, _, _ = compare(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert message.startswith("ok"), message


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
