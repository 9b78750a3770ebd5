"""Every registered query with SQL against DuckDB at the smallest scale, and the entry."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from callwise.plans import sequence
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", [
    "coherence_report", "coherence_next_prev", "eval_summary", "kruskal_wallis", "rank_candidates",
    "trajectory_summary", "clean_prev_fill", "validation_report"])
def test_query_equals_its_sql_when_every_lead_is_sliced(spark, con, monkeypatch, name):
    monkeypatch.setattr(sequence, "ROWS_PER_SLICE", 8)
    assert compare(entry.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
