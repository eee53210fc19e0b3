"""Literal boundary cases of the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shopfloor.functions import arrays, scalars
from shopfloor.operators import alerts, events, evaluate, profile, timeseries
from shopfloor.operators.series import Series
from shopfloor.plans import live

T0 = datetime(2024, 1, 1)


def rows_of(spark, values, kind="double"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"m long, i long, v {kind}")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def by_rows(width):
    return Series(("m",), ("i",), width)


@pytest.mark.parametrize("width", [1, 2, 3, 100])
def test_lookahead(spark, width):
    df = rows_of(spark, [0, 0, 1, 0, 0, 0, 1, 0], "int")
    assert column(timeseries.lookahead_max(df, by_rows(width), "v", 3), "risk_ahead") == [1, 1, 0, 1, 1, 0, 0, 0]
    assert set(column(timeseries.lookahead_max(df, by_rows(width), "v", 8), "risk_ahead")) == {0}
    assert column(timeseries.lookahead_max(df, by_rows(width), "v", 3, tail="null"), "risk_ahead")[-3:] == [None] * 3


@pytest.mark.parametrize("width", [1, 2, 100])
def test_interpolate(spark, width):
    df = rows_of(spark, [None, 1.0, None, None, 4.0, None])
    assert column(timeseries.interpolate(df, by_rows(width), ["v"]), "v") == [None, 1, 2, 3, 4, 4]


@pytest.mark.parametrize("width", [1, 2, 100])
def test_rolling_std(spark, width):
    df = rows_of(spark, [1.0, 2.0, 4.0, None, 7.0, 11.0, 16.0])
    got = column(timeseries.rolling_std(df, by_rows(width), ["v"]), "v_roll_std_6")
    assert got == pytest.approx([0, 0, 1.527525, 1.527525, 2.645751, 4.062019, 5.612486], abs=1e-6)


@pytest.mark.parametrize("width", [1, 100])
def test_forward_fill(spark, width):
    df = rows_of(spark, [None, 1.0, None, None, 4.0, None])
    assert column(timeseries.forward_fill(df, by_rows(width), ["v"]), "v") == [None, 1, 1, 1, 4, 4]


@pytest.mark.parametrize("width", [1, 100])
def test_trend(spark, width):
    df = rows_of(spark, [10.0, 20.0, 40.0, 30.0])
    assert column(timeseries.risk_trend(df, by_rows(width), "v"), "trend") == [0, 0, 15, 5]


@pytest.mark.parametrize("width", [1, 2, 100])
def test_ordinal_progress(spark, width):
    df = rows_of(spark, [1.0] * 5)
    assert column(timeseries.progress(df, by_rows(width)), "progress") == [0, 0.25, 0.5, 0.75, 1]
    assert column(timeseries.progress(rows_of(spark, [1.0]), by_rows(width)), "progress") == [0]


def test_slope_and_stats(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 4.0]), (1, [None, 2.0, 6.0])], "i int, a array<double>")
    assert column(df.select("i", arrays.cycle_slope(F.col("a")).alias("s")), "s") == [1.5, 4.0]
    stats = df.select("i", *[c.alias(k) for k, c in arrays.cycle_stats(F.col("a"), "x").items()])
    assert column(stats, "x_max") == [4, 6]
    assert column(stats, "x_std") == pytest.approx([1.527525, 2.828427], abs=1e-6)


def test_skewness(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 4)], "x double")
    assert df.agg(profile.corrected_skewness(F.col("x"))).first()[0] == pytest.approx(1.697056, abs=1e-6)


def test_soften_and_tiers(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.49, 0.5, 0.81, 0.99)], "p double")
    got = column(df.select("p", scalars.soften(F.col("p")).alias("s")), "s", "p")
    assert got == pytest.approx([31.62, 70.0, 29.29, 56.41, 90.0], abs=0.01)
    tiers = spark.createDataFrame([(x,) for x in (15.0, 15.01, 40.0, 40.01, 80.0, 80.01)], "r double")
    got = column(tiers.select("r", scalars.risk_tier(F.col("r")).alias("t")), "t", "r")
    assert got == ["safe", "watch", "watch", "warning", "warning", "danger"]


@pytest.mark.parametrize("hours", [1, 2, 24 * 30])
def test_days_since(spark, hours):
    s = Series(("m",), ("t",), hours * 3600)
    grid = spark.createDataFrame([(1, T0 + timedelta(hours=h)) for h in range(6)], "m long, t timestamp_ntz")
    log = spark.createDataFrame(
        [(1, T0 + timedelta(hours=1, minutes=30), "comp1"), (1, T0 + timedelta(hours=4), "comp1")], "m long, t timestamp_ntz, c string"
    )
    got = column(events.days_since(grid, log, s, "c", ["comp1"], flag_never=True), "comp1", "t")
    assert got == pytest.approx([0, 0, 0.020833, 0.0625, 0, 0.041667], abs=1e-6)


@pytest.mark.parametrize("hours", [1, 7, 24 * 30])
def test_risk_window_ends(spark, hours):
    s = Series(("m",), ("t",), hours * 3600)
    f = T0 + timedelta(days=3)
    times = [f - timedelta(hours=48), f, f - timedelta(hours=48, seconds=1), f + timedelta(seconds=1)]
    grid = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "i int, m long, t timestamp_ntz")
    failures = spark.createDataFrame([(1, f, "comp1")], "m long, t timestamp_ntz, c string")
    assert column(events.risk_window_labels(grid, failures, s, "c", ["comp1"]), "risk_comp1") == [1, 1, 0, 0]


def test_reset_counter(spark):
    df = spark.range(500).select("id", timeseries.days_since_reset(F.col("id")).alias("d"))
    got = {r["id"]: r["d"] for r in df.collect()}
    assert [got[0], got[400], got[401]] == pytest.approx([5.200694, 0, 0.000694], abs=1e-6)


def test_display_risk(spark):
    cases = [(86.0, 6.0, "danger", 90.3), (84.5, 0.0, "warning", 84.0), (30.0, 3.0, "safe", 33.0), (38.0, 3.0, "safe", 39.0)]
    df = spark.createDataFrame([(i, r, t) for i, (r, t, _, _) in enumerate(cases)], "i int, r double, t double")
    out = df.select("i", alerts.alert_level(F.col("r")).alias("l"), alerts.display_risk(F.col("r"), F.col("t")).alias("d"))
    assert column(out, "l") == [c[2] for c in cases]
    assert column(out, "d") == pytest.approx([c[3] for c in cases])


def test_worst_component(spark):
    df = spark.createDataFrame(
        [(1, "comp1", 0.0), (1, "comp2", 0.0), (2, "comp1", 7.0), (2, "comp2", 7.0), (3, "comp3", 9.0)],
        "machine_id int, comp string, risk double",
    )
    got = {r["machine_id"]: r["worst_comp"] for r in alerts.worst_component(df).collect()}
    assert got == {1: None, 2: "comp1", 3: "comp3"}


def test_auc_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert evaluate.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)


def test_exact_median(spark):
    df = spark.createDataFrame([(1, x) for x in (5.0, 1.0, 1.0, 9.0)] + [(2, 3.0)], "k int, x double")
    got = {r["k"]: r["median"] for r in profile.exact_median(df, ["k"], "x").collect()}
    assert got == {1: 3.0, 2: 3.0}


def test_hour_sums_count_microseconds(spark):
    rows = [(1, 0, T0 + timedelta(microseconds=900_000), 1.0), (1, 1, T0 + timedelta(hours=12), 1.0), (1, 2, T0 + timedelta(days=1, microseconds=100_000), 1.0)]
    rows.append((1, 3, T0 + timedelta(days=1, microseconds=900_000), 1.0))
    df = spark.createDataFrame(rows, "m long, i long, t timestamp_ntz, v double")
    for width in (3600, 86_400, 10**6):
        out = timeseries.rolling_sum_hours(df, Series(("m",), ("t",), width), ["v"], 24, "_24h")
        assert column(out, "v_24h") == [1, 2, 3, 3]


def test_last_of_several_states_wins(spark):
    scored = spark.createDataFrame([(1, 7, T0), (2, 8, T0)], "id long, original_machine_id long, original_datetime timestamp_ntz")
    states = [(7, T0, 1, 5.0), (7, T0, 2, 3.0), (7, T0, 2, 3.0), (9, T0, 1, 1.0)]
    erp = spark.createDataFrame(states, "machine_id long, datetime timestamp_ntz, entry long, age double")
    got = live.lookup_erp(scored, erp, order=["entry"]).select("id", "age").collect()
    assert [tuple(r) for r in got] == [(1, 3.0)]
