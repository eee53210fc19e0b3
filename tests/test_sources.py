"""Readers, writers and table maintenance."""

import pytest
from pyspark.sql import functions as F

from shopfloor import schemas
from shopfloor.operators import machine_etl, models, profile
from shopfloor.operators.machine_etl import press_brake_features
from shopfloor.sources import files, tables


def test_csv_with_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("datetime,machineID,volt,rotate,pressure,vibration\n2015-01-01 06:00:00,1,176.2,NaN,113.0,bad\n")
    row = files.read_csv(spark, str(tmp_path / "t.csv"), schemas.TELEMETRY).first()
    assert row["machineID"] == 1 and row["volt"] == 176.2 and row["rotate"] is None and row["vibration"] is None


def test_matrix_keeps_line_order(spark, tmp_path):
    (tmp_path / "PS1.txt").write_text("".join(f"{i}\t{i + 0.5}\n" for i in range(50)))
    got = files.read_matrix(spark, str(tmp_path / "PS1.txt")).orderBy("cycle_id").collect()
    assert [(r["cycle_id"], r["samples"]) for r in got] == [(i, [i, i + 0.5]) for i in range(50)]


def test_missing_sensor_is_skipped_missing_labels_abort(spark, tmp_path):
    (tmp_path / "PS1.txt").write_text("1\t2\t4\n3\t3\t3\n")
    paths = {n: str(tmp_path / f"{n}.txt") for n in ("PS1", "TS1")}
    sensors = files.read_sensors(spark, paths)
    labels = spark.createDataFrame([(0, 100), (1, 90)], "cycle_id long, valve int")
    out = press_brake_features(sensors, labels, ["PS1", "TS1"]).orderBy("cycle_id").collect()
    assert [r["ps1_slope"] for r in out] == [1.5, 0.0] and out[0]["ts1_mean"] is None
    assert files.read_optional(lambda p: spark.read.text(p), {"profile": str(tmp_path / "no.txt")}, required="profile") is None


def test_scan_tree_reports_bad_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "sub" / "b.txt").write_text("1  2   3\n4 5 6\n")
    (tmp_path / "sub" / "empty.txt").write_text("\n\n")
    status, frames = files.scan_tree(spark, str(tmp_path))
    state = {r["path"].rsplit("/", 1)[1]: r["status"] for r in status.collect()}
    assert state["a.csv"] == "ok" and state["b.txt"] == "ok" and state["empty.txt"].startswith("error")
    text = next(f for p, f in frames.items() if p.endswith("b.txt"))
    assert text.columns == ["Col_1", "Col_2", "Col_3"] and text.count() == 2


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Tool wear [min]` int, Type int")
    assert files.normalize_columns(df).columns == ["tool_wear_min", "type"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(5).withColumn("t", F.timestamp_seconds(F.col("id") * 86_400).cast("timestamp_ntz"))
    tables.write_table(df, path)
    tables.write_table(df, path, "append")
    assert spark.read.parquet(path).count() == 10
    tables.reset_table(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id", "t"]
    daily = str(tmp_path / "daily")
    tables.write_time_table(df, daily, "id", "t")
    assert tables.read_time_table(spark, daily, "t", "1970-01-02 00:00:00", "1970-01-03 00:00:00").count() == 2


def test_leakage_guard(spark):
    df = spark.createDataFrame([(1, 2, 3)], "days_since_x int, tool_hits_count int, keep int")
    assert machine_etl.drop_leakage(df).columns == ["keep"]


def test_column_count(spark):
    got = profile.column_count(spark, {"a": spark.range(1), "b": spark.range(1).withColumn("x", F.lit(1))})
    assert {r["table"]: r["columns"] for r in got.collect()} == {"a": 1, "b": 2}


def test_report_of_an_empty_table(spark):
    rows = profile.column_report({"t": spark.createDataFrame([], "a int")}).collect()
    assert rows[0]["status"] == profile.STATUS_EMPTY and rows[0]["min_value"] == profile.NOT_AVAILABLE


def test_missing_model_scores_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "features array<double>")
    row = models.score(df, {}, ["risk_comp1"]).first()
    assert row["risk_score_risk_comp1"] == 0 and row["model_missing"] == ["risk_comp1"]
    with pytest.raises(ValueError):
        models.score(df, {}, ["risk_comp1"], on_missing="fail")


def test_unify_target_defaults(spark):
    df = spark.createDataFrame([(100.0,), (90.0,), (None,)], "target_valve_condition double")
    got = [r["target_risk"] for r in machine_etl.unify_target(df, "press_brake").collect()]
    assert got == [0, 1, 1]


def test_report_goes_on_after_an_unreadable_table(spark, tmp_path):
    tables_ = {"gone": lambda: spark.read.parquet(str(tmp_path / "gone")), "here": spark.range(3)}
    got = {r["table"]: r for r in profile.column_report(tables_).collect()}
    assert got["gone"]["status"] == profile.STATUS_UNREADABLE and got["gone"]["rows"] is None
    assert got["here"]["status"] == profile.STATUS_COMPLETE and got["here"]["sample_values"] == "0, 1, 2"


def test_whitespace_takes_the_widest_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\n3 4 5 x\n\n6\n")
    rows = files.read_whitespace(spark, str(tmp_path / "a.txt"))
    assert rows.columns == ["Col_1", "Col_2", "Col_3", "Col_4"]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1.0, 2.0, None, None), (3.0, 4.0, 5.0, "x"), (6.0, None, None, None)], key=str)
    with pytest.raises(ValueError):
        files.read_whitespace(spark, str(tmp_path / "a.txt"), columns=2)
    with pytest.raises(ValueError):
        files.read_whitespace(spark, str(tmp_path / "a.txt"), ragged="error")


def test_empty_files_are_reported(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    status, frames = files.scan_tree(spark, str(tmp_path))
    told = {r["path"].rsplit("/", 1)[1]: r["status"] for r in status.collect()}
    assert told == {"e.csv": "error: empty file", "ok.csv": "ok"} and len(frames) == 1
