"""The queries against their SQL, on the test tables and on edge cases."""

import pytest
from conftest import connect_dir

from check_oracle import compare, connect
from trustframe.llm import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, sf, name):
    message, _, _ = compare(spark, connect(sf), sf, name, QUERIES[name], ORACLE[name])
    assert message.startswith("ok"), message


# Near groups are stated for unique ids; their edge cases are tested by brute force.
@pytest.mark.parametrize("name", sorted(set(ORACLE) - {"op6_near_dedup", "op10_warc"}))
def test_edge_cases(spark, edge, name):
    message, _, _ = compare(spark, connect_dir(edge), edge, name, QUERIES[name], ORACLE[name])
    assert message.startswith("ok"), message


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, edge, name):
    assert QUERIES[name](spark, edge + "-empty").count() == 0
