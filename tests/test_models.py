"""Encoder arithmetic and model jobs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from shopfloor.operators import explain as X
from shopfloor.operators import models as M


def slow_state(x, layers):
    """One window at a time, one unit at a time."""
    for layer in layers:
        size = layer["w_rec"].shape[1]
        h = np.zeros(size)
        states = []
        for step in x:
            a, b = layer["w_in"] @ step + layer["b_in"], layer["w_rec"] @ h + layer["b_rec"]
            new = np.empty(size)
            for u in range(size):
                r = 1 / (1 + np.exp(-(a[u] + b[u])))
                z = 1 / (1 + np.exp(-(a[size + u] + b[size + u])))
                n = np.tanh(a[2 * size + u] + r * b[2 * size + u])
                new[u] = (1 - z) * n + z * h[u]
            h = new
            states.append(h)
        x = np.array(states)
    return x[-1]


def test_encoder_matches_plain_loops(spark):
    weights = M.encoder_weights(inputs=4, hidden=5, seed=3)
    windows = np.random.default_rng(1).normal(size=(7, 24, 4))
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(windows)], "i int, window array<array<double>>")
    got = M.encode_sequences(df, weights, keep=["i"]).orderBy("i").collect()
    for r, w in zip(got, windows):
        np.testing.assert_allclose(r["memory"], slow_state(w, weights), atol=1e-5)


def test_encoder_works_in_little_memory_and_each_window_alone():
    weights = [{k: v.astype(np.float32) for k, v in layer.items()} for layer in M.encoder_weights(seed=5)]
    x = np.random.default_rng(2).normal(size=(2 * M.CHUNK + 1, 24, 4)).astype(np.float32)
    x[1, 3, 2] = np.nan
    tracemalloc.start()
    got = M.recurrent_state(x, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # the inputs of one layer alone would take 9.5 MB for all windows and steps
    for i in (0, 2, M.CHUNK - 1, M.CHUNK, 2 * M.CHUNK):
        np.testing.assert_allclose(got[i], slow_state(x[i], weights), atol=1e-5)
    assert np.isnan(got[1]).all()
    for n in (1, 2, 3, 7, M.CHUNK, M.CHUNK + 1):
        np.testing.assert_array_equal(M.recurrent_state(x[:n], weights), got[:n])


def test_encoder_keeps_keys_and_empty_values(spark):
    weights = M.encoder_weights(inputs=2, hidden=3, seed=1)
    rows = [(None, "a", [[1.0, 2.0], [3.0, 4.0]]), (2**60 + 1, None, [[1.0, None], [3.0, 4.0]]), (3, "c", [[0.5, 1.0], [1.0, 0.0]])]
    df = spark.createDataFrame(rows, "i long, t string, window array<array<double>>").coalesce(1)
    out = M.encode_sequences(df, weights, keep=["i", "t"])
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("i", "bigint"), ("t", "string"), ("memory", "array<double>")]
    got = {r["t"]: (r["i"], r["memory"]) for r in out.collect()}
    assert {t: i for t, (i, _) in got.items()} == {"a": None, None: 2**60 + 1, "c": 3}
    assert got[None][1] == [None] * 3
    for _, t, w in (rows[0], rows[2]):
        np.testing.assert_allclose(got[t][1], slow_state(np.array(w), weights), atol=1e-5)
    uneven = spark.createDataFrame([([[1.0, 2.0]],), ([[1.0, 2.0]] * 3,)], "window array<array<double>>").coalesce(1)
    with pytest.raises(PythonException, match="windows of one length"):
        M.encode_sequences(uneven, weights).collect()


NAN = float("nan")


def plain_top(names, w, m, x, k):
    """Names, impacts, shares and signs of the ``k`` largest, by loops."""
    impact = [None if v is None else a * (v - b) for a, b, v in zip(w, m, x)]
    total = None if None in impact else sum(abs(v) for v in impact)
    share = [0.0 if total is None or total == 0 else abs(v) / total * 100 for v in impact]
    size = lambda i: (impact[i] is not None, not (impact[i] is not None and np.isnan(impact[i])), -abs(impact[i] or 0.0), i)
    # Unknown impacts come first, not-a-number last, as Spark sorts negated sizes.
    order = sorted(range(len(x)), key=lambda i: (size(i)[0], not size(i)[1], size(i)[2], i))
    return [(names[i], impact[i], share[i], "+" if impact[i] is not None and (impact[i] > 0 or np.isnan(impact[i])) else "-") for i in order[:k]]


def test_impact_shares_of_odd_rows(spark):
    names, w, m = ["a", "b", "c"], [1.0, -2.0, 0.5], [0.0, 1.0, 2.0]
    rows = [[3.0, 1.0, 8.0], [0.0, 1.0, 2.0], [1.0, 1.5, 4.0], [-1.0, 1.5, 0.0], [None, 4.0, 1.0], [NAN, 4.0, 1.0], [-0.0, 1.0, 2.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>")
    floats = lambda v: F.array(*[F.lit(a) for a in v])
    for n in (None, 3):
        out = df.withColumn("v", X.contributions(F.col("x"), floats(w), floats(m), n))
        out = out.select("i", X.named(names, F.col("v"), F.col("x")).alias("items"))
        out = out.withColumn("items", X.impact_share(F.col("items"), n)).withColumn("top", X.top_contributions(F.col("items"), 2))
        for r in out.collect():
            assert [(y["name"], y["position"]) for y in r["items"]] == [("a", 0), ("b", 1), ("c", 2)]
            np.testing.assert_equal([y["value"] for y in r["items"]], rows[r["i"]])
            got = [(y["name"], y["impact"], y["share"], y["sign"]) for y in r["top"]]
            np.testing.assert_equal(got, plain_top(names, w, m, rows[r["i"]], 2))
    empty = spark.createDataFrame([(None,)], "x array<double>").select(X.named(names, F.col("x"), F.col("x")).alias("items")).first()["items"]
    assert [tuple(y) for y in empty] == [(n, None, None, i) for i, n in enumerate(names)]


def test_impact_share_computes_contributions_and_total_once_a_row(spark):
    names = [f"x{i}" for i in range(14)]
    ones = F.array(*[F.lit(1.0)] * 14)
    df = spark.range(10).select("id", F.array_repeat(F.col("id").cast("double"), 14).alias("x"))
    df = df.withColumn("v", X.contributions(F.col("x"), ones, ones, 14)).select(X.named(names, F.col("v"), F.col("x")).alias("items"))
    plan = df.select(X.impact_share(F.col("items"), 14).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan
    plan = df.select(X.impact_share(F.col("items")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_risk_models_rank_and_flag(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x), float(y)], int(x > 1), 0) for x, y in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "features array<double>, a int, b int")
    models = M.train_risk_models(df, ["a", "b"])
    assert list(models) == ["a"]
    out = M.score(df, models, ["a", "b"]).agg(
        F.avg(F.when(F.col("a") == 1, F.col("p_a"))).alias("hit"), F.avg(F.when(F.col("a") == 0, F.col("p_a"))).alias("miss"),
        F.max("p_b").alias("b"),
    ).first()
    assert out["hit"] > out["miss"] + 0.3 and out["b"] == 0


def test_anomaly_score_is_reconstruction_error(spark):
    rng = np.random.default_rng(0)
    flat = [([float(t), float(2 * t), 0.0], 0) for t in rng.normal(size=50)]
    df = spark.createDataFrame(flat + [([0.0, 0.0, 5.0], 1)], "features array<double>, label int")
    got = M.anomaly_score(df, F.col("label") == 0, k=1).groupBy("label").agg(F.max("anomaly").alias("m")).collect()
    worst = {r["label"]: r["m"] for r in got}
    assert worst[0] < 1e-9 and abs(worst[1] - 25 / 3) < 1e-6
