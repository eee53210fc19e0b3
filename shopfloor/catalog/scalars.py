"""Queries of projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EXPERTS
from ..functions import scalars as S
from ..operators import machine_etl as M
from ..operators import timeseries as TS
from ..sources.grids import scan_machine, time_grid
from ..operators.experts import expert_registry, route
from .events import KEY
from .registry import query

LINE = ["l_orderkey", "l_linenumber"]


def ai4i(v):
    return v.table("lineitem").select(
        *LINE,
        (F.col("l_quantity") / 4 + 290).alias("Air temperature [K]"),
        (F.col("l_quantity") / 2 + 300 + F.col("l_discount")).alias("Process temperature [K]"),
        (F.col("l_extendedprice") / 1000).alias("Torque [Nm]"),
        (F.col("l_partkey") % 250).alias("Tool wear [min]"),
        (F.col("l_returnflag") == "R").cast("int").alias("HDF"),
        (F.col("l_tax") > 0.06).cast("int").alias("OSF"),
    )


SQL_AI4I = """ai4i AS (SELECT l_orderkey, l_linenumber, l_quantity / 4 + 290 AS air, l_quantity / 2 + 300 + l_discount AS process,
  l_extendedprice / 1000 AS torque, l_partkey % 250 AS wear, CAST(l_returnflag = 'R' AS INT) AS hdf,
  CAST(l_tax > 0.06 AS INT) AS osf FROM lineitem)"""


@query("s02_pruned_scan", "", "SELECT l_suppkey AS machine_id, l_shipdate AS datetime FROM lineitem")
def _(v):
    return v.table("lineitem").select(F.col("l_suppkey").alias("machine_id"), F.col("l_shipdate").alias("datetime"))


@query("s08_key_time_scan", "", """SELECT event_id, user_id AS machine_id, ts, value FROM events
  WHERE user_id = 5 AND ts <= TIMESTAMP '2024-01-20'""")
def _(v):
    rows = v.table("events").withColumnRenamed("user_id", "machine_id").select("event_id", "machine_id", "ts", "value")
    return scan_machine(rows, "machine_id", 5, "ts", "2024-01-20 00:00:00")


@query("s14_time_grid", "machines", """SELECT machine_id, t AS datetime FROM machines,
  unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08', INTERVAL 10 MINUTE)) AS g(t)""")
def _(v):
    return time_grid(v.machines().select("machine_id"), "2024-01-01 00:00:00", "2024-01-08 00:00:00", 10)


@query("p01_laser_features", "", SQL_AI4I + """;; SELECT l_orderkey, l_linenumber,
  round(process - 273.15, 6) AS lens_temperature_c, round(air - 273.15, 6) AS laser_source_temp_c,
  round((process - 273.15) - (air - 273.15), 6) AS delta_temperature, round(torque, 6) AS xy_axis_torque_nm,
  wear AS z_axis_tracking_error_proxy, hdf AS target_lens_failure, osf AS target_gantry_failure,
  CAST(trunc(wear / 20) AS INT) AS days_since_lens_inspect FROM ai4i""")
def _(v):
    out = M.laser_features(ai4i(v), LINE)
    cols = ["lens_temperature_c", "laser_source_temp_c", "delta_temperature", "xy_axis_torque_nm"]
    return out.withColumns({c: F.round(c, 6) for c in cols})


def robot_raw(v):
    return v.ev().select(
        "event_id",
        F.col("ts").alias("timestamp"),
        (F.col("value") / 10).alias("vibration_rms"),
        (F.col("k") + 20.0).alias("temperature_motor"),
        (F.col("value") % 7).alias("current_phase_avg"),
        (F.col("k") * 10.0).alias("rpm"),
        (F.col("event_type") == "error").cast("int").alias("failure_within_24h"),
        (F.col("event_id") % 72).alias("hours_since_maintenance"),
    )


@query("p02_robot_features", "ev", """SELECT event_id, ts AS timestamp, round(value / 10, 6) AS robot_vibration_g,
  k + 20.0::DOUBLE AS servo_motor_temp_c, round(value % 7, 6) AS robot_torque_proxy_amp,
  round(k * 10.0::DOUBLE / 100, 6) AS wire_feed_speed_mmin, CAST(event_type = 'error' AS INT) AS target_failure_24h,
  event_id % 72 AS hours_since_maintenance FROM ev""")
def _(v):
    out = M.robot_features(robot_raw(v), ["event_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("robot_vibration_g", "robot_torque_proxy_amp", "wire_feed_speed_mmin")})


def tool_wear(v):
    return v.table("lineitem").select(
        *LINE, F.col("l_tax").alias("AE_rms"), F.col("l_discount").alias("AE_peak"), F.col("l_tax").alias("VB_mm"),
        F.col("l_quantity").alias("CF_Feature_1"), F.col("l_extendedprice").alias("Vib_Feature_1"),
        F.when(F.col("l_returnflag") == "N", "Healthy").when(F.col("l_returnflag") == "R", "Worn").otherwise("Unknown").alias("Wear_Class"),
    )


@query("p03_punching_features", "", """SELECT l_orderkey, l_linenumber, l_quantity AS CF_Feature_1,
  l_extendedprice AS Vib_Feature_1, coalesce(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 END, -1) AS target_wear FROM lineitem""")
def _(v):
    """An unknown class gives NULL, shown here as -1."""
    return M.punching_features(tool_wear(v)).na.fill(-1, ["target_wear"])


@query("p04_drop_leakage", "", SQL_AI4I + """;; SELECT l_orderkey, l_linenumber, round(process - 273.15, 6) AS lens_temperature_c,
  round(air - 273.15, 6) AS laser_source_temp_c, round(process - 273.15 - (air - 273.15), 6) AS delta_temperature, round(torque, 6) AS xy_axis_torque_nm,
  hdf AS target_lens_failure, osf AS target_gantry_failure FROM ai4i""")
def _(v):
    out = M.drop_leakage(M.laser_features(ai4i(v), LINE))
    return out.withColumns({c: F.round(c, 6) for c in ("lens_temperature_c", "laser_source_temp_c", "delta_temperature", "xy_axis_torque_nm")})


def labelled_rows(v):
    """Label columns of all four machine kinds on one row."""
    grades = F.array(*[F.lit(x) for x in (100.0, 90.0, 80.0, 73.0)])
    states = F.array(*[F.lit(x) for x in (130.0, 115.0, 100.0, 90.0)])
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    return v.table("lineitem").select(
        *LINE,
        F.element_at(grades, (line % 4 + 1).cast("int")).alias("target_valve_condition"),
        F.when(part % 5 != 0, (part % 3).cast("double")).alias("target_pump_leakage"),
        F.element_at(states, (part % 4 + 1).cast("int")).alias("target_accumulator_state"),
        (F.col("l_returnflag") == "R").cast("int").alias("target_lens_failure"),
        (F.col("l_tax") > 0.06).cast("int").alias("target_gantry_failure"),
        F.when(F.col("l_returnflag") == "N", "0").when(F.col("l_returnflag") == "R", "1").otherwise("n/a").alias("target_wear"),
        F.when(part % 7 != 0, (part % 2).cast("int")).alias("target_failure_24h"),
    )


SQL_LABELLED = """labelled_rows AS (SELECT l_orderkey, l_linenumber,
  ([100.0, 90.0, 80.0, 73.0])[CAST(l_linenumber % 4 + 1 AS INT)] AS valve,
  CASE WHEN l_partkey % 5 != 0 THEN l_partkey % 3 END AS leak,
  ([130.0, 115.0, 100.0, 90.0])[CAST(l_partkey % 4 + 1 AS INT)] AS acc,
  CAST(l_returnflag = 'R' AS INT) AS lens, CAST(l_tax > 0.06 AS INT) AS gantry,
  CASE l_returnflag WHEN 'N' THEN '0' WHEN 'R' THEN '1' ELSE 'n/a' END AS wear,
  CASE WHEN l_partkey % 7 != 0 THEN l_partkey % 2 END AS fails FROM lineitem)"""


@query("p05_unify_target_remediation", "", SQL_LABELLED + """;; SELECT l_orderkey, l_linenumber,
  CAST(valve != 100 OR coalesce(leak > 0, false) OR acc != 130 AS INT) AS press_brake, CAST(lens > 0 OR gantry > 0 AS INT) AS laser,
  coalesce(CAST(try_cast(wear AS DOUBLE) AS INT), 0) AS punching, CAST(coalesce(fails, 0) AS INT) AS robot FROM labelled_rows""")
def _(v):
    out = labelled_rows(v)
    kinds = ["press_brake", "laser", "punching", "robot"]
    for kind in kinds:
        out = M.unify_target(out, kind, "remediation", kind)
    return out.select(*LINE, *kinds)


@query("p06_unify_target_audit", "", SQL_LABELLED + """;; SELECT l_orderkey, l_linenumber,
  CAST(valve != 100 OR coalesce(leak != 0, true) OR acc < 115 AS INT) AS press_brake, CAST(lens != 0 OR gantry != 0 AS INT) AS laser,
  CAST(fails AS INT) AS robot FROM labelled_rows WHERE fails IS NOT NULL""")
def _(v):
    out = labelled_rows(v)
    kinds = ["press_brake", "laser", "robot"]
    for kind in kinds:
        out = M.unify_target(out, kind, "audit", kind)
    return out.select(*LINE, *kinds)


@query("p07_binarize", "", SQL_LABELLED + """;; SELECT l_orderkey, l_linenumber, CAST(valve < 100 AS INT) AS is_degrading FROM labelled_rows""")
def _(v):
    return labelled_rows(v).select(*LINE, S.binarize(F.col("target_valve_condition")).alias("is_degrading"))


@query("p08_usage_counter", "", """SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 5000 AS tool_hits_count FROM orders""")
def _(v):
    rows = v.table("orders").select("o_orderdate", "o_orderkey")
    return TS.usage_counter(rows, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_INDEXED = "i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders)"


@query("p09_days_since_reset", "", _INDEXED + """;; SELECT o_orderkey, round(CASE WHEN row_index >= 1200 THEN (row_index - 1200) / 1440
  WHEN row_index >= 400 THEN (row_index - 400) / 1440 ELSE 5.2 + (row_index + 1) / 1440 END, 6) AS days_since_oil_filter FROM i""")
def _(v):
    rows = TS.ordered_index(v.table("orders").select("o_orderkey"), ["o_orderkey"])
    return rows.select("o_orderkey", F.round(TS.days_since_reset(F.col("row_index")), 6).alias("days_since_oil_filter"))


@query("p10_assign_timestamps", "", _INDEXED + """;; SELECT o_orderkey, TIMESTAMP '2024-01-01' + row_index * INTERVAL 15 MINUTE AS timestamp FROM i""")
def _(v):
    rows = TS.ordered_index(v.table("orders").select("o_orderkey"), ["o_orderkey"])
    return rows.select("o_orderkey", TS.assign_timestamps(F.col("row_index"), "2024-01-01 00:00:00", 15).alias("timestamp"))


@query("p11_soften", "scores", """SELECT event_id, round(100 * CASE WHEN risk / 100 < 0.5 THEN sqrt(risk / 100)
  ELSE 1 - sqrt(1 - risk / 100) END, 6) AS softened FROM scores""")
def _(v):
    return v.scores().select("event_id", F.round(S.soften(F.col("risk") / 100), 6).alias("softened"))


@query("p12_risk_tier", "scores", """SELECT event_id, CASE WHEN risk > 80 THEN 'danger' WHEN risk > 40 THEN 'warning'
  WHEN risk > 15 THEN 'watch' ELSE 'safe' END AS tier FROM scores""")
def _(v):
    return v.scores().select("event_id", S.risk_tier(F.col("risk")).alias("tier"))


@query("p13_risk_tier_cuts", "scores", """SELECT event_id, CASE WHEN risk > 80 THEN 'danger' WHEN risk > 50 THEN 'warning'
  WHEN risk > 20 THEN 'watch' ELSE 'safe' END AS replay_tier, CASE WHEN risk > 80 THEN 'danger' WHEN risk > 40 THEN 'warning'
  ELSE 'safe' END AS display_tier FROM scores""")
def _(v):
    return v.scores().select(
        "event_id", S.risk_tier(F.col("risk"), (80, 50, 20)).alias("replay_tier"), S.risk_tier(F.col("risk"), (80, 40)).alias("display_tier")
    )


@query("p14_operation_level", "live_metrics", """SELECT event_id, CASE WHEN load_percentage < 50 THEN 1 WHEN load_percentage < 80 THEN 2
  ELSE 3 END AS operation_level, CASE WHEN load_percentage > 80 THEN 'high' WHEN load_percentage > 40 THEN 'medium' ELSE 'low' END AS load_bar
  FROM live_metrics""")
def _(v):
    load = F.col("load_percentage")
    return v.live_metrics().select("event_id", S.operation_level(load).alias("operation_level"), S.load_bar(load).alias("load_bar"))


@query("p15_floor_hour", "ev", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS hour FROM ev")
def _(v):
    return v.ev().select("event_id", S.floor_hour(F.col("ts")).alias("hour"))


@query("p16_shift_time", "failures", """SELECT event_id, machine_id, datetime AS original_datetime,
  datetime + (TIMESTAMP '2026-06-01' - (SELECT max(datetime) FROM failures)) AS datetime FROM failures""")
def _(v):
    rows = v.failures().select("event_id", "machine_id", "datetime")
    latest = rows.agg(F.max("datetime")).scalar()
    return S.shift_time(rows, "datetime", latest, F.lit("2026-06-01 00:00:00").cast("timestamp_ntz"))


@query("p17_elapsed", "ev", """SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0, 6) AS days,
  round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0, 6) AS hours FROM ev""")
def _(v):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return v.ev().select(
        "event_id", F.round(S.elapsed(start, F.col("ts"), "days"), 6).alias("days"), F.round(S.elapsed(start, F.col("ts"), "hours"), 6).alias("hours")
    )


@query("p18_parse_format_time", "ev", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown,
  strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS parsed FROM ev""")
def _(v):
    shown = S.format_time(F.col("ts"))
    return v.ev().select("event_id", shown.alias("shown"), S.parse_time(shown).alias("parsed"))


@query("p19_payload", "telemetry", """SELECT machine_id, datetime, '{"volt":' || volt || ',"rotate":' || rotate || ',"pressure":' || pressure || ',"vibration":' || vibration || ',"original_machine_id":' || machine_id || '}' AS payload
  FROM telemetry""")
def _(v):
    rows = v.telemetry().withColumn("original_machine_id", F.col("machine_id"))
    return rows.select(*KEY, S.to_payload(["volt", "rotate", "pressure", "vibration", "original_machine_id"]).alias("payload"))


@query("p20_payload_get", "", """SELECT event_id, CAST(props->>'$.k' AS INT) AS k_int, CAST(props->>'$.k' AS DOUBLE) AS k_float, props->>'$.k' AS k_text,
  props->>'$.absent' AS absent FROM events""")
def _(v):
    fields = S.payload_get(F.col("props"), {"k": T.StringType(), "absent": T.StringType()})
    return v.table("events").withColumn("p", fields).select(
        "event_id", F.col("p.k").cast("int").alias("k_int"), F.col("p.k").cast("double").alias("k_float"),
        F.col("p.k").alias("k_text"), F.col("p.absent").alias("absent"),
    )


@query("p21_text", "machines", """SELECT machine_id, machine_type || ' #' || machine_id AS label, lower(machine_code) AS low, upper(machine_type) AS up,
  left(machine_code, 10) AS short, lpad(CAST(machine_id AS VARCHAR), 4, '0') AS padded, split_part(machine_code, '#', 1) AS prefix,
  right(machine_code, 1) AS last_char, contains(machine_type, 'laser') AS is_laser,
  CASE machine_type WHEN 'laser' THEN 'cutting' WHEN 'robot' THEN 'welding' ELSE machine_type END AS alias FROM machines""")
def _(v):
    kind, code = F.col("machine_type"), F.col("machine_code")
    return v.machines().select(
        "machine_id", S.machine_label(kind, F.col("machine_id")).alias("label"), F.lower(code).alias("low"), F.upper(kind).alias("up"),
        F.left(code, F.lit(10)).alias("short"), F.lpad(F.col("machine_id").cast("string"), 4, "0").alias("padded"),
        F.split_part(code, F.lit("#"), F.lit(1)).alias("prefix"), F.right(code, F.lit(1)).alias("last_char"),
        F.contains(kind, F.lit("laser")).alias("is_laser"),
        F.when(kind == "laser", "cutting").when(kind == "robot", "welding").otherwise(kind).alias("alias"),
    )


@query("p22_round", "telemetry", "SELECT machine_id, datetime, round(sqrt(rotate), 1) AS r1, round(sqrt(rotate), 3) AS r3 FROM telemetry")
def _(v):
    return v.telemetry().select(*KEY, F.round(F.sqrt("rotate"), 1).alias("r1"), F.round(F.sqrt("rotate"), 3).alias("r3"))


@query("p23_fill", "ev", """SELECT event_id, coalesce(CASE WHEN k % 3 = 0 THEN value END, 0) AS value,
  coalesce(CASE WHEN k % 2 = 0 THEN event_type END, 'N/A') AS event_type FROM ev""")
def _(v):
    k = F.col("k")
    rows = v.ev().select("event_id", F.when(k % 3 == 0, F.col("value")).alias("value"), F.when(k % 2 == 0, F.col("event_type")).alias("event_type"))
    return rows.na.fill({"value": 0.0, "event_type": "N/A"})


@query("p24_to_number", "", SQL_LABELLED + """;; SELECT l_orderkey, l_linenumber, coalesce(try_cast(wear AS DOUBLE), -1) AS wear FROM labelled_rows""")
def _(v):
    return labelled_rows(v).select(*LINE, F.coalesce(S.to_number(F.col("target_wear")), F.lit(-1.0)).alias("wear"))


@query("p26_range_and_not_in", "ev", """SELECT event_id, machine_id, ts, value FROM ev
  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15' AND machine_id NOT IN (6, 10)""")
def _(v):
    return v.ev().filter(
        F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-15").cast("timestamp_ntz"))
        & ~F.col("machine_id").isin(6, 10)
    ).select("event_id", "machine_id", "ts", "value")


@query("p27_hybrid_vector", "memory", """SELECT row_id, CAST(len(memory) + 3 AS INT) AS width, round(list_sum(memory) + label + row_id % 20 + 1.5, 6) AS total FROM memory""")
def _(v):
    vector = S.hybrid(F.col("memory"), [F.col("label"), F.col("row_id") % 20, F.lit(1.5)])
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return v.memory().select("row_id", F.size(vector).alias("width"), F.round(total, 6).alias("total"))


_REGISTRY = "registry AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{e['kind']}', {e['time_steps']}, {e['lookahead']}, {e['risk_threshold']}::DOUBLE, '{e['target_col']}', {len(e['dynamic_cols'])})" for e in EXPERTS
) + ") AS t(machine_type, time_steps, lookahead, risk_threshold, target_col, n_inputs))"


@query("p28_expert_routing", "machines", _REGISTRY + """;; SELECT machine_id, machine_type, time_steps, lookahead, risk_threshold, target_col, n_inputs
  FROM machines LEFT JOIN registry USING (machine_type)""")
def _(v):
    registry = expert_registry(v.spark).drop("machine_type").withColumnRenamed("kind", "machine_type")
    return route(v.machines().select("machine_id", "machine_type"), registry).select(
        "machine_id", "machine_type", "time_steps", "lookahead", "risk_threshold", "target_col", F.size("dynamic_cols").alias("n_inputs")
    )


_ETL = SQL_AI4I + """,
  i AS (SELECT *, row_number() OVER (ORDER BY wear, l_orderkey, l_linenumber, air, process, torque, hdf, osf) - 1 AS n FROM ai4i),
  t AS (SELECT *, TIMESTAMP '2024-01-01' + n * INTERVAL 1 HOUR AS timestamp, process - 273.15 AS lens, air - 273.15 AS src FROM i)"""


@query("p10_remediate_laser", "", _ETL + """;; SELECT l_orderkey, l_linenumber, timestamp, round(lens, 6) AS lens_temperature_c,
  CAST(hdf > 0 OR osf > 0 AS INT) AS target_risk,
  round(coalesce(CASE WHEN count(lens) OVER w >= 3 THEN stddev_samp(lens) OVER w END, 0), 4) AS lens_temperature_c_roll_std_6,
  round(coalesce(CASE WHEN count(torque) OVER w >= 3 THEN stddev_samp(torque) OVER w END, 0), 4) AS xy_axis_torque_nm_roll_std_6
  FROM t WINDOW w AS (ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(v):
    """The whole cleaning chain on the laser table: times, target, deviations, leakage guard."""
    rows = M.laser_features(ai4i(v), LINE)
    order = ["z_axis_tracking_error_proxy", *LINE, "laser_source_temp_c", "lens_temperature_c", "xy_axis_torque_nm",
             "target_lens_failure", "target_gantry_failure"]
    out = M.remediate(rows, "laser", order)
    digits = {"lens_temperature_c": 6, "lens_temperature_c_roll_std_6": 4, "xy_axis_torque_nm_roll_std_6": 4}
    return out.select(*LINE, "timestamp", "target_risk", *[F.round(c, d).alias(c) for c, d in digits.items()])


_HALVES = """halves AS (SELECT cycle_id, label, samples[1:32] AS ps1, samples[33:64] AS ts1 FROM cycles)"""


def _stats(name: str) -> str:
    return f"""round(list_avg({name}), 6) AS {name}_mean, round(list_max({name}), 6) AS {name}_max, round(list_stddev_samp({name}), 6) AS {name}_std"""


@query("a02_cycle_stats", "cycles", f"SELECT cycle_id, {_stats('samples')} FROM cycles")
def _(v):
    from ..functions.arrays import cycle_stats

    return v.cycles().select("cycle_id", *[F.round(c, 6).alias(k) for k, c in cycle_stats(F.col("samples"), "samples").items()])


@query("a03_cycle_slope", "cycles", """SELECT cycle_id, round((samples[20] - samples[1]) / 19, 6) AS slope FROM cycles""")
def _(v):
    from ..functions.arrays import cycle_slope

    return v.cycles().select("cycle_id", F.round(cycle_slope(F.col("samples"), 20), 6).alias("slope"))


@query("a04_press_brake_features", "cycles", f"""{_HALVES};; SELECT cycle_id, label, {_stats('ps1')}, {_stats('ts1')},
  round((ps1[32] - ps1[1]) / 31, 6) AS ps1_slope, TIMESTAMP '2026-01-01 08:00:00' + cycle_id * INTERVAL 1 MINUTE AS timestamp,
  round(CASE WHEN cycle_id >= 1200 THEN (cycle_id - 1200) / 1440 WHEN cycle_id >= 400 THEN (cycle_id - 400) / 1440
    ELSE 5.2 + (cycle_id + 1) / 1440 END, 6) AS days_since_oil_filter FROM halves""")
def _(v):
    cycles = v.cycles()
    sensors = cycles.select(
        "cycle_id",
        F.explode(F.array(
            F.struct(F.lit("PS1").alias("sensor"), F.slice("samples", 1, 32).alias("samples")),
            F.struct(F.lit("TS1").alias("sensor"), F.slice("samples", 33, 32).alias("samples")),
        )).alias("s"),
    ).select("cycle_id", "s.*")
    out = M.press_brake_table(sensors, cycles.select("cycle_id", "label"), ["PS1", "TS1"])
    numbers = [c for c in out.columns if c.startswith(("ps1_", "ts1_", "days"))]
    return out.withColumns({c: F.round(c, 6) for c in numbers})


@query("o05_dedup_by_time", "ev", """SELECT machine_id, hour, event_id, value FROM (SELECT machine_id, date_trunc('hour', ts) AS hour, event_id, value,
  row_number() OVER (PARTITION BY machine_id, date_trunc('hour', ts) ORDER BY event_id) AS n FROM ev) WHERE n = 1""")
def _(v):
    rows = v.ev().select("machine_id", S.floor_hour(F.col("ts")).alias("hour"), "event_id", "value")
    return M.dedup_by_time(rows, ["machine_id"], "hour", ["event_id"])
