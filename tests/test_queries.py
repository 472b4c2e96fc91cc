"""Registered queries beside their SQL twins. TEST_QUERIES=all runs every one of them."""

import os

import pytest
from compare import check, duck

import __spark_entry__ as contract
from marketlens.bindings.registry import load_all

CORE = (
    "settlement_backtest depth_vwap causal_state lock_gate series_quality prior_probability residual_calibration fixed_effect_step blocks "
    "drawdown date_block_bootstrap verdict level_changes book_at asof_forward_latency settled_fills fact_scorecard threshold_cross_fill "
    "tournament_trades gaussian_bucket_rule track_tournament hour_percentiles line_summary radius_count nearest_cell merge_refreshed pick_source pair_edge "
    "fee_schedule sequence_status health_transitions causal_labels case_replay ladder_underround best_run nowcast daily_report "
    "classify_contracts resolve_rules source_family phrase_score archive_hours retention_plan climate_normalise archive_scan stream_health"
).split()

REGISTERED = load_all()
NAMES = list(REGISTERED) if os.environ.get("TEST_QUERIES") == "all" else CORE


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, sf_dir, name):
    line = check(spark, con, REGISTERED[name], sf_dir)
    assert line.startswith("OK"), line


def test_contract_functions(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 6
