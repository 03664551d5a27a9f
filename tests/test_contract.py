"""Driver contract and a sample of queries against DuckDB on the smallest fixtures."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "s01_16_date_month_consistency",
    "s01_18b_quality_gate_summary",
    "s02_03_churn_by_tenure",
    "s02_15_churn_signals",
    "s03_01_profile_snapshot",
    "s03_14_profile_signals",
    "s04_10_voice_deterioration",
    "s05_11_value_concentration",
    "s06_13_service_consistency",
    "s07_12_temporal_x_value",
    "s08_07_pareto_deciles",
    "s09_13_executive_segments",
    "s10_09_priority_ranking",
    "f09_treatment_map",
    "f16_three_month_summary",
    "m09_cv_oof",
    "t01_threshold_sweep",
    "v01_value_table",
    "e06_sensitivity_grid",
    "x03_direction",
    "d01_drift_monitor",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 230


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "tenure_band"
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    verdict = compare(spark, duck, SF, name, entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict
