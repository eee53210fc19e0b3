"""Streams against their batch twins, for splits of the input at any place."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shopfloor.fixtures import feed
from shopfloor.operators.scaling import apply_scaler, fit_scaler
from shopfloor.operators.series import Series
from shopfloor.operators.windows import latest_per_key, sequences
from shopfloor.plans.live import alert_history
from shopfloor.session import new_path
from shopfloor.streaming import jobs, sources, state

T0 = datetime(2024, 1, 1)
S = Series(("machine_id",), ("ts", "event_id"), 3 * 3600)


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, i % 3 if i % 2 else 0, T0 + timedelta(minutes=17 * i), float((i * 37) % 101)) for i in range(120)]
    return spark.createDataFrame(rows, "event_id long, machine_id long, ts timestamp_ntz, risk double")


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


@pytest.mark.parametrize("cuts", [["2024-01-01 05:00:00"], ["2024-01-01 00:10:00", "2024-01-01 20:00:00"]])
def test_alerts_do_not_depend_on_batches(spark, scores, cuts):
    job = jobs.alert_states(scores.schema, S, new_path(spark, "alerts"), delay="2 hours")
    for path in feed(scores, "ts", cuts, "scores"):
        job.start(sources.file_stream(spark, path, scores.schema))
    same(job.result(spark), alert_history(scores, S))
    assert job.late(spark) == 0


def test_a_stopped_job_goes_on_and_takes_late_rows(spark, scores):
    path, folder = new_path(spark, "feed"), new_path(spark, "alerts")
    parts = ["event_id <= 40 AND event_id <> 33", "event_id = 33 OR event_id BETWEEN 41 AND 80", "event_id > 80"]
    for part in parts:
        scores.filter(part).write.mode("append").parquet(path)
        job = jobs.alert_states(scores.schema, S, folder, delay="6 hours")
        query = job.start(sources.file_stream(spark, path, scores.schema))
        assert not query.isActive
    same(job.result(spark), alert_history(scores, S))
    scores.filter("event_id = 3").withColumn("event_id", F.lit(900).cast("long")).write.mode("append").parquet(path)
    job.start(sources.file_stream(spark, path, scores.schema))
    same(job.result(spark), alert_history(scores, S))
    assert job.late(spark) == 1


def test_windows_take_late_rows(spark, scores):
    path, folder = new_path(spark, "feed"), new_path(spark, "windows")
    job = jobs.live_windows(scores.schema, S, ["risk"], folder, n=5, delay="6 hours")
    for part in ("event_id <= 40 AND event_id <> 33", "event_id = 33 OR event_id > 40"):
        scores.filter(part).write.mode("append").parquet(path)
        job.start(sources.file_stream(spark, path, scores.schema))
    same(job.result(spark).select("event_id", "window"), sequences(scores, S, ["risk"], 5).select("event_id", "window"))


@pytest.mark.parametrize("least", [2, 5])
def test_scaled_windows_from_few_rows_on(spark, scores, least):
    scaler = fit_scaler(scores, ["risk"])
    job = jobs.live_windows(scores.schema, S, ["risk"], new_path(spark, "windows"), n=5, min_rows=least, scaler=scaler)
    for path in feed(scores, "ts", ["2024-01-01 05:00:00"], "scores"):
        job.start(sources.file_stream(spark, path, scores.schema))
    want = sequences(apply_scaler(scores, scaler, ["risk"]), S, ["risk"], 5, min_rows=least)
    assert {r["n"] for r in want.select(F.size("window").alias("n")).collect()} == set(range(least, 6))
    same(job.result(spark).select("event_id", "window"), want.select("event_id", "window"))


def stored_windows(spark, parts, folder, **settings):
    """Windows out of the state store after each part has arrived; a last row of another machine moves the watermark on."""
    path = new_path(spark, "feed")
    for part in parts:
        part.write.mode("append").parquet(path)
        out = state.window_state(sources.file_stream(spark, path, part.schema), ["risk"], 5, **settings)
        jobs.stream_to_table(out, folder)
    return jobs.table(spark, folder, out.schema)


@pytest.mark.parametrize("least", [2, 5])
def test_stored_windows_take_late_rows_after_a_restart(spark, scores, least):
    timed = scores.withColumn("ts", F.col("ts").cast("timestamp"))
    end = timed.limit(1).select(F.lit(9999).cast("long").alias("event_id"), F.lit(77).cast("long").alias("machine_id"), (F.max("ts").over(Window.partitionBy()) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0.0).alias("risk"))
    parts = [timed.filter("event_id <= 40 AND event_id <> 33"), timed.filter("event_id = 33 OR event_id BETWEEN 41 AND 80"), timed.filter("event_id > 80"), end]
    scaler = fit_scaler(scores, ["risk"])
    folder = new_path(spark, "stored")
    got = stored_windows(spark, parts, folder, min_rows=least, scaler=scaler, delay="6 hours").filter("machine_id <> 77")
    want = sequences(apply_scaler(scores, scaler, ["risk"]), S, ["risk"], 5, min_rows=least)
    same(got.select("event_id", "window"), want.select("event_id", "window"))


def test_stored_windows_go_on_from_history_and_forget_silent_machines(spark):
    schema = "event_id long, machine_id long, ts timestamp, risk double"
    rows = lambda *xs: spark.createDataFrame([(i, m, T0 + timedelta(days=d), float(r)) for i, m, d, r in xs], schema)
    history = rows((1, 1, 0, 10), (2, 1, 1, 11))
    parts = [rows((3, 1, 2, 12), (4, 2, 2, 20)), rows((5, 2, 60, 21)), rows((6, 1, 61, 13), (7, 2, 61, 22)), rows((8, 3, 200, 0))]
    got = stored_windows(spark, parts, new_path(spark, "stored"), min_rows=1, delay="0 seconds", days_to_live=30, history=history)
    found = {r["event_id"]: [x[0] for x in r["window"]] for r in got.collect()}
    # Machine 1 starts with its history; both machines are silent for more than 30 days and start anew.
    assert found == {3: [10, 11, 12], 4: [20], 5: [21], 6: [13], 7: [21, 22], 8: [0]}


def test_stored_windows_without_rows_or_times(spark):
    schema = "event_id long, machine_id long, ts timestamp, risk double"
    parts = [spark.createDataFrame([], schema), spark.createDataFrame([(1, 1, None, 1.0), (2, 1, T0, None), (3, 1, T0, 2.0)], schema)]
    got = stored_windows(spark, parts, new_path(spark, "stored"), min_rows=1, delay="0 seconds").collect()
    assert sorted((r["event_id"], r["window"]) for r in got) == [(2, [[None]]), (3, [[None], [2.0]])]


def test_live_states_meet_ticks_whichever_comes_first(spark):
    at = lambda h, m=0: T0 + timedelta(hours=h, minutes=m)
    ticks = [[(1, 1, at(1, 5)), (2, 2, at(1, 50))], [(3, 1, at(2)), (4, 1, at(2, 59))], [(5, 1, at(90))], [(6, 1, at(99))]]
    states = [[(1, at(1), 7)], [(2, at(1), 8), (1, at(3), 0)], [(1, at(2), 9), (1, at(90), 5)], [(1, at(99), 6)]]
    machines = spark.createDataFrame([(1, "m1")], "machine_id long, model string")
    left, right, folder = (new_path(spark, x) for x in ("ticks", "states", "enriched"))
    kinds = "event_id long, machine_id long, ts timestamp", "machine_id long, datetime timestamp, error1 int"
    for a, b in zip(ticks, states):
        spark.createDataFrame(a, kinds[0]).write.mode("append").parquet(left)
        spark.createDataFrame(b, kinds[1]).write.mode("append").parquet(right)
        out = jobs.enrich_live(sources.file_stream(spark, left, kinds[0]), sources.file_stream(spark, right, kinds[1]), machines, delay="24 hours")
        jobs.stream_to_table(out, folder)
    got = {r["event_id"]: (r["error1"], r["model"]) for r in jobs.table(spark, folder, out.schema).collect()}
    assert got == {1: (7, "m1"), 2: (8, None), 3: (9, "m1"), 4: (9, "m1"), 5: (5, "m1"), 6: (6, "m1")}


def test_a_tick_without_state_comes_out_when_its_hour_has_passed(spark):
    at = lambda h: T0 + timedelta(hours=h)
    left, right, folder = (new_path(spark, x) for x in ("ticks", "states", "enriched"))
    kinds = "event_id long, machine_id long, ts timestamp", "machine_id long, datetime timestamp, error1 int"
    machines = spark.createDataFrame([], "machine_id long, model string")
    for h in (1, 50):
        spark.createDataFrame([(h, 1, at(h))], kinds[0]).write.mode("append").parquet(left)
        spark.createDataFrame([(2, at(h), 3)], kinds[1]).write.mode("append").parquet(right)
        out = jobs.enrich_live(sources.file_stream(spark, left, kinds[0]), sources.file_stream(spark, right, kinds[1]), machines)
        jobs.stream_to_table(out, folder)
    assert [(r["event_id"], r["error1"], r["model"]) for r in jobs.table(spark, folder, out.schema).collect()] == [(1, None, None)]


def test_upsert_keeps_latest(spark, scores):
    folder = new_path(spark, "latest")
    for path in feed(scores, "ts", ["2024-01-01 05:00:00", "2024-01-01 12:00:00"], "scores"):
        jobs.upsert_latest(sources.file_stream(spark, path, scores.schema), ["machine_id"], ["ts", "event_id"], folder)
    same(jobs.latest(spark, folder, scores.schema), latest_per_key(scores, ["machine_id"], ["ts", "event_id"]).select(scores.columns))


def test_state_store_equals_the_batch_twin(spark, scores):
    timed = scores.withColumn("ts", F.col("ts").cast("timestamp"))
    for days in (None, 30):
        folder = new_path(spark, "stored")
        for path in feed(timed, "ts", ["2024-01-01 12:00:00"], "scores"):
            out = state.alert_state(sources.file_stream(spark, path, timed.schema), days_to_live=days)
            jobs.stream_to_table(out, folder)
        got = jobs.table(spark, folder, out.schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        same(got, alert_history(scores, S))


def test_repeated_rows_are_dropped(spark, scores):
    twice = scores.unionByName(scores).select("machine_id", "ts")
    folder = new_path(spark, "once")
    for path in feed(twice, "ts", ["2024-01-01 12:00:00"], "twice"):
        stream = sources.with_event_time(sources.file_stream(spark, path, twice.schema), "ts", ["machine_id"], "1 day")
        jobs.stream_to_table(stream, folder)
    assert jobs.table(spark, folder, stream.schema).count() == scores.count()
