"""Registered queries against their SQL on the smallest data set.

A spread of queries runs by default; ``SHOPFLOOR_ALL=1`` runs every one.
"""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
SPREAD = [
    "a01_event_counts", "a05_profile", "a07_audit_profile", "a11_time_coverage", "a12_column_report", "a17_reliability", "a19_roc_auc",
    "a22_worst_component", "j03_days_since_maint", "j05_erp_matrix", "j16_context_before", "j17_failure_slice", "m03_fit_apply_split",
    "m09_linear_scores", "p05_unify_target_remediation", "p10_remediate_laser", "p21_text", "t06_upsert_latest", "t08_live_status",
    "a13_column_count", "j07_lookup_erp", "m10_missing_models", "s04_read_whitespace", "s05_scan_tree", "s06_read_optional", "s07_read_sensors",
    "s13_reset_table", "t03_live_windows", "t04_alert_states", "t05_enrich_stream", "t07_write_predictions", "w01_rolling_sum_hours", "w15_progress",
    "e01_expert_dataset", "t03_live_window_store", "t05_enrich_live", "w04_lookahead_1000", "w08_interpolate", "w11_sequences", "w14_reasons", "w16_ordered_index", "w17_synthetic_sequence", "w18_slice_by_ordinal",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("SHOPFLOOR_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SPREAD) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    verdict = compare(got, duck.execute(entry.oracle_sql()[name]).df())
    assert not verdict or verdict.startswith("near"), verdict


def test_top_correlations_keep_every_column(spark, duck):
    """All eight numeric columns of ``lineitem`` come back, from the query and from its SQL."""
    names = {f.name for f in spark.read.parquet(f"{SF}/lineitem.parquet").schema if f.dataType.typeName() in ("long", "integer", "double")}
    got = entry.queries()["a10_top_correlations"](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()["a10_top_correlations"]).df()
    assert set(got["column"]) == set(want["column"]) == names
    assert not compare(got, want)
