"""Every registered query equals its DuckDB oracle SQL on the sf0.001 tables."""

from __future__ import annotations

import os

import pytest

from oracle_check import compare
from tricklens.plans.oracle import oracle_queries
from tricklens.plans.queries import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_all_queries_match_oracle(spark):
    results = compare(spark, SF, list(registry()))
    bad = [(name, info) for name, ok, info in results if not ok]
    assert not bad, bad


def test_every_query_has_an_oracle():
    import __spark_entry__ as entry

    assert set(registry()) == set(oracle_queries())
    assert set(registry()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_rounds_played"] > 0
