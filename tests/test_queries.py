"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "events embeddings lineitem".split()
CHECKED = [
    "A2_cohort_load", "B4_modal_length_trials", "B20_feedback_epoch_merge", "B22_typical_trial_band", "C1_nearest_time_join",
    "C9_trace_difference", "D5_condition_combinations", "D11_reward_rate_time", "D16_stay_switch_matrix", "D40_time_accuracy_slope",
    "D44_quantile_loss", "E1_outcome_streaks", "E5_speed_class", "E6_remainder_cursor", "E8_learned_value", "F6_percentile_scale",
    "F15_outlier_rows", "F18_cut_long_traces", "F20_normalise_time", "G4_mann_whitney_u", "G21_hierarchical_bootstrap", "T6_missing_point_estimate",
]


def norm(v):
    return None if v is None or v != v else (repr(v) if isinstance(v, float) else str(v))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    spot = [rel.columns.index(c) for c in cols]
    want = sorted(str([norm(r[i]) for i in spot]) for r in rel.fetchall())
    assert sorted(str([norm(r[c]) for c in cols]) for r in got.collect()) == want
    assert want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_paired():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
