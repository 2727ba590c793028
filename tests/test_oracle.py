"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import pytest

from check import compare, oracle_connection
from tallybook.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.oracle is not None])
def test_matches_duckdb(spark, duck, name):
    ok, note = compare(spark, duck, SF, name)
    assert ok, note


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.queries())
