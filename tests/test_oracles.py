"""Every registered query of the market engine against its SQL twin."""

from __future__ import annotations

import pytest

from marketlens import registry
from marketlens.operators import quantiles
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_twin(spark, con, name):
    assert rows_of(registry.queries()[name](spark, SF)) == rows_of_sql(con, registry.oracles()[name])


@pytest.mark.parametrize("name", ["market_totals", "market_segment_medians", "market_unit_price_histogram", "market_target_maps", "join_baseline", "window_quintiles", "validity_errors_by_district"])
def test_large_groups_have_the_same_quantiles(spark, con, monkeypatch, name):
    """The way for groups beyond one task's memory, on tables that are small."""
    monkeypatch.setattr(quantiles, "ONE_TASK", -1)
    assert rows_of(registry.queries()[name](spark, SF)) == rows_of_sql(con, registry.oracles()[name])


def test_every_twin_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
