"""A cross-section of the registered queries against DuckDB; tests/compare.py runs them all."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

NAMES = ["flow_summary", "max_pain", "profile_levels", "break_even_aggregate_payoff", "level_clusters", "rolling_flow", "resample_4h", "asof_backward", "calendar_blackout", "ema", "adx",
         "supertrend", "zigzag", "market_structure", "order_blocks", "liquidity_pools", "signal_macd_cross", "signal_orb", "first_touch_outcomes", "performance_metrics", "thinned_signals",
         "continuation_by_hour", "pair_residual", "reference_turns", "quote_minutes", "model_metrics", "venue_trade_payload", "stream_minute_bars", "stream_live_levels"]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(NAMES) <= set(o)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    err, rows = compare(spark, con, sf, entry.queries()[name], entry.oracle_sql()[name])
    assert err is None, err


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
