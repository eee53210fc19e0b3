"""Shape of the physical plans."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def built(spark, name):
    return plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize(
    "name",
    ["j03_days_since_maint", "j04_risk_window_labels", "j05_erp_matrix", "j16_context_before", "j17_failure_slice",
     "w01_rolling_sum", "w04_lookahead_max", "w08_interpolate", "w10_last_n", "w11_sequences", "w17_synthetic_sequence"],
)
def test_no_cross_join_no_python(spark, name):
    text = built(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_frames_are_evaluated_in_one_pass(spark):
    for name in ("j04_risk_window_labels", "j05_erp_matrix", "w08_interpolate"):
        assert "UnboundedFollowing" not in built(spark, name).replace("unboundedfollowing", "UnboundedFollowing")


def test_pruned_scan(spark):
    text = built(spark, "s02_pruned_scan")
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_pushed_predicates(spark):
    text = built(spark, "s08_key_time_scan")
    assert "EqualTo(user_id,5)" in text and "LessThanOrEqual(ts" in text


def test_top_n_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in built(spark, "w10_last_n")


def test_borders_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in built(spark, "w01_rolling_sum")


@pytest.mark.parametrize("name, scans, exchanges", [("w04_lookahead_max", 2, 6), ("w04_lookahead_2880", 2, 6), ("w08_interpolate", 2, 6)])
def test_one_summary_per_slice(spark, name, scans, exchanges):
    """Look-ahead of any length has one plan: rows, their slice counts, and one copy for the block before."""
    text = built(spark, name).split("\n\n")[0]
    assert text.count("Scan parquet") <= scans and text.count("Exchange") <= exchanges
