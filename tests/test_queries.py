"""Named queries against their SQL statements. GRIDTIDE_ALL=1 runs every key at sf0.01."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import check  # noqa: E402

from gridtide.catalog import REGISTRY  # noqa: E402

ALL = os.environ.get("GRIDTIDE_ALL") == "1"
SF = "/root/testdata/sf0.01" if ALL else "/root/testdata/sf0.001"
SAMPLE = [
    "utc_to_market_parts", "market_parts_to_utc", "holiday_flag_federal", "wind_physics_features", "csv_header_mapping", "html_table_to_rows",
    "upsert_last_write", "asof_reserves", "score_join_null_safe", "fallback_4_sources", "fuel_pct_hourly", "regional_grid_stats",
    "audit_interval_gaps", "split_by_date", "roc_pr_auc", "pr_curve_20", "backtest_metrics", "curtailment_schedule", "battery_rule_schedule",
    "spike_price_features", "label_all_points", "rolling_percent_rank", "event_sessions", "ramp_events", "stream_tumbling_15min",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return check.connect(SF)


@pytest.mark.parametrize("key", list(REGISTRY) if ALL else SAMPLE)
def test_query_matches_statement(spark, con, key):
    ok, message = check.compare(spark, con, REGISTRY[key], SF)
    assert ok, message


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
