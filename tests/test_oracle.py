"""Every registered query against its DuckDB twin (sf0.001 here; the driver uses sf0.01)."""

from __future__ import annotations

import os

import pytest

from oracle_check import DATA, ORACLES, QUERIES, compare, connect

SF = os.environ.get("ASSETLOOM_SF", "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/{SF}")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, name, f"{DATA}/{SF}")
    # a small table may leave a special case empty on both sides
    assert problem in (None, "both empty"), problem


def test_catalogue_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= len(QUERIES) - 3


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert entry(spark).count() > 0
    assert queries().keys() >= oracle_sql().keys()
