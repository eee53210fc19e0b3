"""Sliced operators against pandas on random series, for slice widths that cut them anywhere."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopfloor.operators import timeseries as TS
from shopfloor.operators import windows as W
from shopfloor.operators.series import Series, bounded, ordinal, running_sum, slice_width
from pyspark.sql import functions as F

few = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def make(seed, hot):
    """Three machines with irregular times; the first holds most rows when ``hot``."""
    rng = np.random.default_rng(seed)
    parts = []
    for m, n in enumerate((60 if hot else 15, 11, 1)):
        at = np.sort(rng.choice(400, size=n, replace=False))
        value = rng.integers(0, 50, n).astype(float)
        value[rng.random(n) < 0.2] = np.nan
        parts.append(pd.DataFrame({"m": m, "i": at, "v": value}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    rows = [(int(r.m), int(r.i), None if np.isnan(r.v) else float(r.v)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "m long, i long, v double")


def ordered(df, name):
    pdf = df.toPandas().sort_values(["m", "i"])
    return pdf[name].astype(float).to_numpy()


@few
@given(seed=st.integers(0, 10_000), width=st.sampled_from([1, 7, 50, 1000]), hot=st.booleans())
def test_against_pandas(spark, seed, width, hot):
    pdf = make(seed, hot)
    df = to_spark(spark, pdf).cache()
    s = Series(("m",), ("i",), width)
    groups = pdf.groupby("m")["v"]

    want = groups.rolling(24, min_periods=1).sum().to_numpy()
    np.testing.assert_allclose(ordered(TS.rolling_sum(df, s, ["v"], 24, "_s"), "v_s"), want)

    want = groups.rolling(6, min_periods=3).std().fillna(0).to_numpy()
    np.testing.assert_allclose(ordered(TS.rolling_std(df, s, ["v"]), "v_roll_std_6"), want, atol=1e-6)

    want = groups.ffill().to_numpy()
    np.testing.assert_allclose(ordered(TS.forward_fill(df, s, ["v"]), "v"), want)

    want = pdf.groupby("m")["v"].transform(lambda v: v.interpolate()).to_numpy()
    np.testing.assert_allclose(ordered(TS.interpolate(df, s, ["v"]), "v"), want)

    filled = pdf.fillna(0)
    ahead = filled.groupby("m")["v"].transform(lambda v: v.rolling(9, min_periods=1).max().shift(-9)).fillna(0).to_numpy()
    np.testing.assert_allclose(ordered(TS.lookahead_max(df.na.fill(0.0), s, "v", 9), "risk_ahead"), ahead)

    one = filled.groupby("m")["v"].transform(lambda v: v.shift(-1)).fillna(0).to_numpy()
    np.testing.assert_allclose(ordered(TS.lookahead_max(df.na.fill(0.0), s, "v", 1), "risk_ahead"), one)

    want = filled.groupby("m")["v"].cumsum().to_numpy()
    np.testing.assert_allclose(ordered(running_sum(df, s, {"c": "v"}), "c"), want)

    want = pdf.groupby("m").cumcount().to_numpy()
    np.testing.assert_array_equal(ordered(ordinal(df, s), "ordinal"), want)
    df.unpersist()


def test_ordered_index_is_a_permutation(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("hot"), F.xxhash64("id").alias("h"), "id")
    got = TS.ordered_index(df, ["hot", "h", "id"]).orderBy("hot", "h", "id").select("row_index").collect()
    assert [r[0] for r in got] == list(range(1000))


def test_sequences_cross_sparse_slices(spark):
    """A window may reach over several slices that hold one row each."""
    df = spark.createDataFrame([(1, i * 10, float(i)) for i in range(10)], "m long, i long, v double")
    got = W.sequences(df, Series(("m",), ("i",), 10), ["v"], 4).orderBy("i").collect()
    assert [[x[0] for x in r["window"]] for r in got] == [[float(j) for j in range(i - 3, i + 1)] for i in range(3, 10)]


def test_two_sided_frame(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "m long, i long, v double")
    out = bounded(df, Series(("m",), ("i",), 3), 5, 5, lambda w: {"s": F.sum("v").over(w.rowsBetween(-5, 5))})
    got = [r["s"] for r in out.orderBy("i").collect()]
    assert got == [float(sum(range(max(0, i - 5), min(20, i + 6)))) for i in range(20)]


def test_slice_width_measures_density(spark):
    df = spark.range(7200).select(F.lit(1).alias("m"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"))
    assert slice_width(df, Series(("m",), ("t",)), rows=36_000) == 36_000


@pytest.mark.parametrize("width", [3600, 7200, 10**6])
def test_hours_frame(spark, width):
    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=50, freq="37min"), "v": np.arange(50.0)})
    want = pdf.rolling("5h", on="t")["v"].sum().to_numpy()
    df = spark.createDataFrame(pdf).select(F.lit(1).alias("m"), F.col("t").cast("timestamp_ntz").alias("t"), "v")
    got = TS.rolling_sum_hours(df, Series(("m",), ("t",), width), ["v"], 5, "_s").orderBy("t").select("v_s").collect()
    np.testing.assert_allclose([r[0] for r in got], want)
