"""Queries of sources, sinks and streaming jobs over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMPONENTS, ERRORS, SENSORS
from ..fixtures import EVENTS, TELEMETRY, feed
from ..functions.scalars import operation_level, risk_tier, to_payload
from ..operators.machine_etl import press_brake_features
from ..operators.scaling import fit_scaler
from ..plans.erp import erp_matrix
from ..session import materialize, new_path
from ..sources import files, tables
from ..streaming import jobs, sources, state
from .alerts import SQL_HISTORY
from .events import KEY, SQL_ERROR_FEATURES, SQL_SINCE
from .profiles import ORDERS, orders
from .registry import query

# Where replays split January 2024, so that each stream runs several micro-batches.
CUTS = ["2024-01-08", "2024-01-16", "2024-01-24"]


def fed(v, df, ts, label, start):
    """Start the job anew after each part of the feed has arrived."""
    for path in feed(df, ts, CUTS, label):
        start(sources.file_stream(v.spark, path, df.schema))


def appended(v, df, ts, label, make):
    """All rows that an append job puts out over several starts."""
    folder, schema = new_path(v.spark, label), []

    def start(stream):
        out = make(stream)
        schema.append(out.schema)
        jobs.stream_to_table(out, folder)

    fed(v, df, ts, f"{label}-feed", start)
    return jobs.table(v.spark, folder, schema[0])


def scores(v):
    return v.scores().drop("label")


@query("s01_csv_scan", "", f"SELECT {', '.join(ORDERS)} FROM orders")
def _(v):
    path = new_path(v.spark, "orders-csv")
    tables.write_csv(orders(v), path)
    return files.read_csv(v.spark, path, ", ".join(f"{c} {t}" for c, t in ORDERS.items()))


@query("s03_read_matrix", "", """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cycle_id, CAST(len(embedding) AS INT) AS n,
  round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings""")
def _(v):
    """Vectors written as tab-separated lines and read back in line order."""
    path = new_path(v.spark, "matrix")
    lines = v.table("embeddings").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    text = F.concat_ws("\t", F.transform("embedding", lambda x: x.cast("double").cast("string")))
    lines.select(text.alias("value")).write.text(path)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return files.read_matrix(v.spark, path).select("cycle_id", F.size("samples").alias("n"), F.round(total, 5).alias("total"))


@query("s04_read_whitespace", "", """SELECT CAST(o_orderkey AS DOUBLE) AS "Col_1", CAST(o_custkey AS DOUBLE) AS "Col_2", o_totalprice AS "Col_3", o_orderstatus AS "Col_4", split_part(o_orderpriority, ' ', 1) AS "Col_5",
  nullif(split_part(o_orderpriority, ' ', 2), '') AS "Col_6" FROM orders""")
def _(v):
    path = new_path(v.spark, "whitespace")
    v.table("orders").select(F.concat_ws("   ", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")]).alias("value")).write.text(path)
    return files.read_whitespace(v.spark, path)


@query("s05_scan_tree", "", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(v):
    """A tree of one folder per status, read file by file and put together again."""
    root = new_path(v.spark, "tree")
    for status in "FOP":
        tables.write_csv(v.table("orders").filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey", "o_orderstatus"), f"{root}/{status}")
    _, frames = files.scan_tree(v.spark, root)
    parts = [f.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus") for f in frames.values()]
    return reduce(DataFrame.unionByName, parts)


@query("s06_read_optional", "", "SELECT 'orders' AS source, o_orderkey, o_custkey FROM orders")
def _(v):
    """Sources that exist, each under its name; one that does not is left out."""
    path = new_path(v.spark, "optional")
    tables.write_csv(v.table("orders").select("o_orderkey", "o_custkey"), path)
    found = files.read_optional(lambda p: files.read_csv(v.spark, p, "o_orderkey long, o_custkey long"), {"orders": path, "gone": f"{path}-gone"})
    return reduce(DataFrame.unionByName, [f.withColumn("source", F.lit(name)) for name, f in found.items()])


@query("s07_read_sensors", "", """WITH n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS cycle_id FROM embeddings)
  SELECT 'PS1' AS sensor, cycle_id, CAST(embedding[1] AS DOUBLE) AS first FROM n UNION ALL SELECT 'TS1', cycle_id, CAST(embedding[2] AS DOUBLE) FROM n""")
def _(v):
    """Two sensor files out of three as one long table."""
    root = new_path(v.spark, "sensors")
    ordered = v.table("embeddings").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    for k, name in enumerate(("PS1", "TS1")):
        ordered.select(F.col("embedding")[k].cast("double").cast("string").alias("value")).write.text(f"{root}/{name}")
    found = files.read_sensors(v.spark, {name: f"{root}/{name}" for name in ("PS1", "TS1", "CE")})
    return found.select("sensor", "cycle_id", F.col("samples")[0].alias("first"))


@query("s13_reset_table", "ev", "SELECT event_id, machine_id, value FROM ev")
def _(v):
    """Rows written before a reset are gone, rows after it stay."""
    rows, path = v.ev().select("event_id", "machine_id", "value"), new_path(v.spark, "reset")
    tables.write_table(rows.withColumn("value", F.col("value") + 1000), path)
    tables.reset_table(v.spark, path)
    tables.write_table(rows, path, "append")
    return v.spark.read.schema(rows.schema).parquet(path)


@query("s07_normalize_columns", "", """SELECT event_id, ts AS event_time, event_type AS event_kind_raw, value AS "value_(mv)" FROM events""")
def _(v):
    """Headings with blanks, capitals and brackets as column names."""
    rows = v.table("events")
    return files.normalize_columns(rows.select(
        F.col("event_id").alias("Event ID"), F.col("ts").alias("Event Time"), F.col("event_type").alias("Event Kind [raw]"), F.col("value").alias("VALUE (mV)"),
    ))


@query("s11_append_table", "ev", "SELECT event_id, machine_id, ts, value FROM ev")
def _(v):
    """Ticks appended one part after the other give the whole table."""
    rows = v.ev().select("event_id", "machine_id", "ts", "value")
    path = new_path(v.spark, "appended")
    tables.write_table(rows.filter("ts < '2024-01-16'"), path)
    tables.write_table(rows.filter("ts >= '2024-01-16'"), path, "append")
    return v.spark.read.schema(rows.schema).parquet(path)


@query("s12_time_partitioned_table", "telemetry", """SELECT machine_id, datetime, volt FROM telemetry
  WHERE datetime BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-07 12:00:00'""")
def _(v):
    path = new_path(v.spark, "hourly")
    tables.write_time_table(v.telemetry().select(*KEY, "volt"), path, "machine_id", "datetime")
    return tables.read_time_table(v.spark, path, "datetime", "2024-01-05 06:00:00", "2024-01-07 12:00:00")


@query("t01_telemetry_stream", "ev", "SELECT event_id, machine_id, ts, value, k FROM ev")
def _(v):
    """Stream with the JSON payload parsed into columns."""
    raw = v.table("events").select("event_id", F.col("user_id").alias("machine_id"), "ts", "value", "props")
    return appended(v, raw, "ts", "parsed", lambda stream: sources.telemetry_stream(stream, "props", "k int"))


@query("t02_dedup_stream", "ev", "SELECT DISTINCT machine_id, date_trunc('hour', ts)::TIMESTAMP AS hour FROM ev")
def _(v):
    """One row per machine and hour within the watermark."""
    rows = v.ev().select("machine_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    once = appended(v, rows, "hour", "deduplicated", lambda stream: sources.with_event_time(stream, "hour", ["machine_id"], "2 days"))
    return once.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


SQL_WINDOWS = """
  p AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM ev),
  s AS (SELECT event_id, machine_id, ts, list([(value - mv) / sv, (k - mk) / sk]) OVER w AS win
    FROM ev CROSS JOIN p WINDOW w AS (PARTITION BY machine_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW));;
  SELECT event_id, machine_id, ts, len(win)::INT AS n,
    round(list_sum(list_transform(win, lambda x, i: (x[1] + 2 * x[2]) * i)) / len(win), 4) AS digest FROM s"""


def digested(windows):
    """A number that depends on every value of a window and on its place."""
    weighted = F.transform("window", lambda x, i: (x[0] + 2 * x[1]) * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return windows.select("event_id", "machine_id", "ts", F.size("window").alias("n"), F.round(total / F.size("window"), 4).alias("digest"))


@query("t03_live_windows", "ev", SQL_WINDOWS + " WHERE len(win) >= 24")
def _(v):
    """Scaled windows emitted over several micro-batches equal those of one batch."""
    rows = v.ev().select("event_id", "machine_id", "ts", "value", "k")
    cols = ["value", "k"]
    job = jobs.live_windows(rows.schema, EVENTS, cols, new_path(v.spark, "live-windows"), scaler=fit_scaler(rows, cols))
    fed(v, rows, "ts", "ticks", job.start)
    return digested(job.result(v.spark))


@query("t03_live_window_store", "ev", SQL_WINDOWS + " WHERE len(win) >= 2")
def _(v):
    """The same windows, from two rows on, out of Spark's state store."""
    rows = v.ev().select("event_id", "machine_id", F.col("ts").cast("timestamp").alias("ts"), "value", "k")
    cols, scaler = ["value", "k"], fit_scaler(rows, ["value", "k"])
    out = appended(v, rows, "ts", "stored-windows", lambda stream: state.window_state(stream, cols, scaler=scaler, delay="0 seconds"))
    return digested(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("t04_alert_states", "scores", SQL_HISTORY + ";; SELECT * FROM shown")
def _(v):
    job = jobs.alert_states(scores(v).schema, EVENTS, new_path(v.spark, "alert-states"))
    fed(v, scores(v), "ts", "scores", job.start)
    out = job.result(v.spark)
    return out.withColumns({c: F.round(c, 6) for c in ("trend", "display_risk")})


@query("t04_alert_state_store", "scores", SQL_HISTORY + ";; SELECT * FROM shown")
def _(v):
    """The same states from Spark's state store."""
    rows = scores(v).withColumn("ts", F.col("ts").cast("timestamp"))
    out = appended(v, rows, "ts", "stored-alerts", state.alert_state)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumns({c: F.round(c, 6) for c in ("trend", "display_risk")})


@query("t05_enrich_stream", "scores machines", """SELECT s.event_id, s.machine_id, s.risk, coalesce(m.model, 'N/A') AS model, coalesce(m.age, -1) AS age,
  coalesce(m.machine_type, 'N/A') AS machine_type FROM scores s LEFT JOIN machines m USING (machine_id)""")
def _(v):
    machines = v.machines().select("machine_id", "model", "age", "machine_type")

    def make(stream):
        out = jobs.enrich(stream, machines, None).select("event_id", "machine_id", "risk", "model", "age", "machine_type")
        return out.na.fill("N/A").na.fill(-1, ["age"])

    return appended(v, scores(v), "ts", "enriched", make)


STATE = [*ERRORS, *COMPONENTS, "age"]


@query("t05_enrich_live", "ev errors maint machines scores", f"""telemetry AS (SELECT DISTINCT machine_id, date_trunc('hour', ts)::TIMESTAMP AS datetime FROM ev),
  {SQL_ERROR_FEATURES}, {SQL_SINCE};;
  SELECT s.event_id, s.machine_id, s.ts, s.risk, {", ".join(f"e.{c}" for c in ERRORS)}, {", ".join(f"round(d.{c}, 6) AS {c}" for c in COMPONENTS)},
    coalesce(m.age, -1) AS age, coalesce(m.model, 'N/A') AS model, coalesce(m.machine_type, 'N/A') AS machine_type
  FROM scores s JOIN error_sums e ON e.machine_id = s.machine_id AND e.datetime = date_trunc('hour', s.ts)
    JOIN since d ON d.machine_id = s.machine_id AND d.datetime = e.datetime LEFT JOIN machines m ON m.machine_id = s.machine_id""")
def _(v):
    """Scored ticks joined as a stream with the ten state features of their machine-hour, which come as a second stream."""
    ticks = scores(v).withColumn("ts", F.col("ts").cast("timestamp"))
    hours = v.ev().select("machine_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime")).distinct()
    states = erp_matrix(hours, v.errors(), v.maint(), v.failures(), v.machines(), TELEMETRY).select("machine_id", "datetime", *STATE)
    states = materialize(states.withColumn("datetime", F.col("datetime").cast("timestamp")), "live-states")
    machines = v.machines().select("machine_id", "model", "machine_type")
    folder = new_path(v.spark, "enriched-live")
    for left, right in zip(feed(ticks, "ts", CUTS, "live-ticks"), feed(states, "datetime", CUTS, "live-states-feed")):
        out = jobs.enrich_live(sources.file_stream(v.spark, left, ticks.schema), sources.file_stream(v.spark, right, states.schema), machines)
        jobs.stream_to_table(out, folder)
    rows = jobs.table(v.spark, folder, out.schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rows.withColumns({c: F.round(c, 6) for c in COMPONENTS}).na.fill("N/A").na.fill(-1, ["age"])


@query("t06_upsert_latest", "live_metrics", """SELECT machine_id, event_id, load_percentage, CASE WHEN load_percentage < 50 THEN 1
  WHEN load_percentage < 80 THEN 2 ELSE 3 END AS operation_level, updated_at FROM live_metrics
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY updated_at DESC, event_id DESC) = 1""")
def _(v):
    rows = v.live_metrics().withColumn("operation_level", operation_level(F.col("load_percentage")))
    folder = new_path(v.spark, "latest")
    fed(v, rows, "updated_at", "metrics", lambda stream: jobs.upsert_latest(stream, ["machine_id"], ["updated_at", "event_id"], folder))
    return jobs.latest(v.spark, folder, rows.schema)


@query("t07_write_predictions", "predictions", """SELECT event_id, machine_id, comp, time, risk_probability, CASE WHEN risk_probability > 80 THEN 'danger'
  WHEN risk_probability > 40 THEN 'warning' WHEN risk_probability > 15 THEN 'watch' ELSE 'safe' END AS reason FROM predictions""")
def _(v):
    rows = v.predictions().drop("is_verified_true").withColumn("reason", risk_tier(F.col("risk_probability")))
    folder = new_path(v.spark, "predictions")
    fed(v, rows, "time", "scored", lambda stream: jobs.write_predictions(stream, folder))
    return jobs.table(v.spark, folder, rows.schema)
