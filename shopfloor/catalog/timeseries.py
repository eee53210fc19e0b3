"""Queries of the rolling, carrying and positional operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ERRORS, EXPERTS, SENSORS
from ..fixtures import EVENTS, TELEMETRY
from ..operators import events as E
from ..operators import timeseries as TS
from ..operators.series import DAY, Series
from ..plans.experts import expert_dataset
from .events import KEY, SQL_ERROR_FEATURES, grid
from .registry import query


def SQL_HASH(column: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {column}, {seed})), 1, 15) AS BIGINT)"



@query("w01_rolling_sum", "telemetry errors", f"{SQL_ERROR_FEATURES};; SELECT * FROM error_sums")
def _(v):
    counted = E.error_features(grid(v), v.errors(), KEY, "error_id", ERRORS)
    return TS.rolling_sum(counted, TELEMETRY, ERRORS, 24)


@query("w01_rolling_sum_hours", "ev", """
  SELECT event_id, machine_id, ts, round(sum(value) OVER (PARTITION BY machine_id ORDER BY ts
    RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW), 4) AS value_24h FROM ev""")
def _(v):
    """Clock-time variant on irregular events."""
    rows = v.ev().select("event_id", "machine_id", "ts", "value")
    out = TS.rolling_sum_hours(rows, EVENTS, ["value"], 24, "_24h").drop("value")
    return out.withColumn("value_24h", F.round("value_24h", 4))


@query("w02_rolling_std", "telemetry", f"""
  SELECT machine_id, datetime, {", ".join(
    f"round(CASE WHEN count({c}) OVER w >= 3 THEN stddev_samp({c}) OVER w ELSE 0 END, 4) AS {c}_roll_std_6" for c in SENSORS)}
  FROM telemetry WINDOW w AS (PARTITION BY machine_id ORDER BY datetime ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(v):
    out = TS.rolling_std(v.telemetry(), TELEMETRY, SENSORS).drop(*SENSORS)
    return out.withColumns({f"{c}_roll_std_6": F.round(f"{c}_roll_std_6", 4) for c in SENSORS})


_GAPPY = "gappy AS (SELECT event_id, machine_id, ts, CASE WHEN k % 3 = 0 THEN value END AS value FROM ev)"


def gappy(v):
    return v.ev().select("event_id", "machine_id", "ts", F.when(F.col("k") % 3 == 0, F.col("value")).alias("value"))


@query("w03_forward_fill", "ev", _GAPPY + """;;
  SELECT event_id, machine_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM gappy""")
def _(v):
    return TS.forward_fill(gappy(v), EVENTS, ["value"])


@query("w04_lookahead_max", "ev", """
  SELECT event_id, machine_id, ts, CASE WHEN lead(1, 48) OVER w IS NULL THEN 0 ELSE
    max(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY machine_id ORDER BY ts, event_id
      ROWS BETWEEN 1 FOLLOWING AND 48 FOLLOWING) END AS risk_ahead
  FROM ev WINDOW w AS (PARTITION BY machine_id ORDER BY ts, event_id)""")
def _(v):
    rows = v.ev().select("event_id", "machine_id", "ts", (F.col("event_type") == "signup").cast("int").alias("target"))
    return TS.lookahead_max(rows, EVENTS, "target", 48).drop("target")


def _ahead(rows: int) -> str:
    return f"""
  SELECT event_id, ts, CASE WHEN lead(1, {rows}) OVER w IS NULL THEN 0 ELSE
    max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND {rows} FOLLOWING) END AS risk_ahead
  FROM ev WINDOW w AS (ORDER BY ts, event_id)"""


def _ahead_of_all(rows: int):
    def build(v):
        """The look-ahead of the expert registry over the feed of all machines as one series."""
        one = Series((), EVENTS.order, DAY)
        return TS.lookahead_max(v.ev().select("event_id", "ts", "value"), one, "value", rows).drop("value")

    return build


for _rows in sorted({e["lookahead"] for e in EXPERTS}):
    query(f"w04_lookahead_{_rows}", "ev", _ahead(_rows))(_ahead_of_all(_rows))


@query("w05_has_history", "telemetry", """
  SELECT machine_id, datetime, row_number() OVER (PARTITION BY machine_id ORDER BY datetime) >= 24 AS has_history
  FROM telemetry""")
def _(v):
    return TS.has_history(grid(v), TELEMETRY, 24)


@query("w06_transitions", "ev", """
  d AS (SELECT event_id, machine_id, ts, coalesce(target - lag(target) OVER (PARTITION BY machine_id ORDER BY ts, event_id), 0) AS diff
    FROM (SELECT *, CAST(event_type = 'error' AS INT) AS target FROM ev));;
  SELECT *, CAST(diff = 1 AS INT) AS is_onset FROM d""")
def _(v):
    rows = v.ev().select("event_id", "machine_id", "ts", (F.col("event_type") == "error").cast("int").alias("target"))
    return TS.transitions(rows, EVENTS, "target").drop("target")


@query("w07_gaps", "ev", """
  SELECT event_id, machine_id, ts,
    coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY machine_id ORDER BY ts, event_id))) // 1000000, -1) AS gap_seconds FROM ev""")
def _(v):
    return TS.gaps(v.ev().select("event_id", "machine_id", "ts"), EVENTS).na.fill(-1, ["gap_seconds"])


@query("w08_interpolate", "ev", _GAPPY + """,
  n AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) AS i FROM gappy),
  b AS (SELECT *,
    last_value(value IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi,
    first_value(value IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni
    FROM n WINDOW p AS (PARTITION BY machine_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f AS (PARTITION BY machine_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING));;
  SELECT event_id, machine_id, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN nv IS NULL THEN pv
    ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS value FROM b""")
def _(v):
    return TS.interpolate(gappy(v), EVENTS, ["value"]).withColumn("value", F.round("value", 6))


@query("w15_progress", "telemetry", """
  SELECT machine_id, datetime, round((row_number() OVER (PARTITION BY machine_id ORDER BY datetime) - 1)
      / greatest(1, count(*) OVER (PARTITION BY machine_id) - 1), 6) AS progress FROM telemetry""")
def _(v):
    return TS.progress(v.telemetry().select(*TELEMETRY.keys, "datetime"), TELEMETRY).withColumn("progress", F.round("progress", 6))


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query("w16_ordered_index", "", f"""
  SELECT {", ".join(_LINE_ORDER)}, row_number() OVER (ORDER BY {", ".join(_LINE_ORDER)}) - 1 AS row_index FROM lineitem""")
def _(v):
    return TS.ordered_index(v.table("lineitem").select(*_LINE_ORDER), _LINE_ORDER)


@query("w17_synthetic_sequence", "", """
  s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(l_returnflag = 'R' AS INT) AS target,
      row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index FROM lineitem);;
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_index, CASE WHEN lead(1, 100) OVER (ORDER BY row_index) IS NULL THEN 0
    ELSE max(target) OVER (ORDER BY row_index ROWS BETWEEN 1 FOLLOWING AND 100 FOLLOWING) END AS risk_ahead FROM s""")
def _(v):
    """Samples ordered by wear, then labelled by looking 100 rows ahead, in blocks of rows."""
    by = ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = v.table("lineitem").select(*by, (F.col("l_returnflag") == "R").cast("int").alias("target"))
    rows, series = TS.synthetic_sequence(rows, by, block=10_000)
    return TS.lookahead_max(rows, series, "target", 100).drop("target", "l_quantity")


@query("w18_slice_by_ordinal", "telemetry", f"""
  n AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY datetime) - 1 AS i,
      count(*) OVER (PARTITION BY machine_id) AS n FROM telemetry),
  f AS (SELECT *, i - {SQL_HASH("machine_id", 7)} % (n - 50) AS step FROM n WHERE n >= 51);;
  SELECT machine_id, datetime, volt, rotate, pressure, vibration, step FROM f WHERE step BETWEEN 0 AND 50""")
def _(v):
    return TS.slice_by_ordinal(v.telemetry(), TELEMETRY, 51, seed=7)


@query("w19_last_event", "failures", """
  SELECT machine_id, arg_max(datetime, (datetime, event_id)) AS datetime, arg_max(failure, (datetime, event_id)) AS failure
  FROM failures GROUP BY machine_id""")
def _(v):
    return TS.last_event(v.failures(), ["machine_id"], ["datetime", "event_id"], ["datetime", "failure"])


@query("w20_risk_trend", "scores", """
  SELECT event_id, machine_id, ts, round(coalesce((risk - lag(risk, 2) OVER (PARTITION BY machine_id ORDER BY ts, event_id)) / 2, 0), 6) AS trend
  FROM scores""")
def _(v):
    rows = v.scores().select("event_id", "machine_id", "ts", "risk")
    return TS.risk_trend(rows, EVENTS, "risk").withColumn("trend", F.round("trend", 6)).drop("risk")


# Sensors stand in for the columns of the expert files, the speed for the wear to come.
def _expert_sql(kind: str, n: int, ahead: int) -> tuple[str, str]:
    cols = [*SENSORS, "age"]
    params = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in cols)
    steps = " + ".join(f"{i} * ({c} - m_{c}) / s_{c}" for i, c in enumerate(SENSORS, 1))
    parts = f"""l_{kind} AS (SELECT *, CASE WHEN lead(1, {ahead}) OVER w IS NULL THEN 0 ELSE
      max(rotate) OVER (ORDER BY datetime, machine_id ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING) END AS label,
      row_number() OVER w - 1 < floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) AS is_train
    FROM t WHERE machine_type = '{kind}' WINDOW w AS (ORDER BY datetime, machine_id)),
  p_{kind} AS (SELECT {params} FROM l_{kind} WHERE is_train),
  s_{kind} AS (SELECT machine_type, machine_id, datetime, is_train, label, round((age - m_age) / s_age, 6) AS age, list({steps}) OVER
      (PARTITION BY is_train ORDER BY datetime, machine_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS win
    FROM l_{kind} CROSS JOIN p_{kind})"""
    final = f"""SELECT machine_type, machine_id, datetime, is_train, label, age, len(win)::INT AS n,
    round(list_sum(list_transform(win, lambda x, i: x * i)) / len(win), 3) AS digest FROM s_{kind} WHERE len(win) = {n}"""
    return parts, final


_EXPERT_PARTS = [_expert_sql(e["kind"], e["time_steps"], e["lookahead"]) for e in EXPERTS]


@query("e01_expert_dataset", "telemetry machines", """t AS (SELECT t.*, m.machine_type, m.age FROM telemetry t JOIN machines m USING (machine_id)),
  """ + ",\n  ".join(p for p, _ in _EXPERT_PARTS) + ";;\n  " + "\n  UNION ALL ".join(f for _, f in _EXPERT_PARTS))
def _(v):
    """Labelled, split, scaled windows of each expert's machines, with the lengths of the registry."""
    rows = v.telemetry().join(v.machines().select("machine_id", "machine_type", "age"), "machine_id")
    s = Series(("machine_type",), ("datetime", "machine_id"), 7 * DAY)
    sets = [
        expert_dataset(rows.filter(F.col("machine_type") == e["kind"]), s, SENSORS, ["age"], "rotate", e["time_steps"], e["lookahead"])
        for e in EXPERTS
    ]
    step = lambda x: sum(((i + 1) * x[i] for i in range(1, len(SENSORS))), x[0])
    total = F.aggregate(F.transform("window", lambda x, i: step(x) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return reduce(DataFrame.unionByName, sets).select(
        "machine_type", "machine_id", "datetime", "is_train", "label", F.round("age", 6).alias("age"), F.size("window").alias("n"),
        F.round(total / F.size("window"), 3).alias("digest"),
    )
