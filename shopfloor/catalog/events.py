"""Queries joining a telemetry grid with event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COMPONENTS, ERRORS, SENSORS
from ..fixtures import TELEMETRY, Views
from ..operators import events as E
from ..operators.series import DAY, Series
from ..plans.erp import erp_matrix
from .registry import query

KEY = ("machine_id", "datetime")


def grid(v: Views):
    return v.telemetry().select(*KEY)


def matrix(v: Views):
    return erp_matrix(grid(v), v.errors(), v.maint(), v.failures(), v.machines(), TELEMETRY)


def stored_matrix(v: Views):
    """The matrix as a table, for the queries that look states up in it."""
    return v.stored("erp-matrix", lambda: matrix(v))


_COUNTS = ", ".join(f"count(*) FILTER (error_id = '{e}') AS {e}" for e in ERRORS)

SQL_COUNTS = f"counts AS (SELECT machine_id, datetime, {_COUNTS} FROM errors GROUP BY ALL)"
SQL_ERROR_FEATURES = f"""{SQL_COUNTS},
  error_grid AS (SELECT t.machine_id, t.datetime, {", ".join(f"coalesce({e}, 0) AS {e}" for e in ERRORS)}
    FROM telemetry t LEFT JOIN counts c USING (machine_id, datetime)),
  error_sums AS (SELECT machine_id, datetime, {", ".join(
    f"CAST(sum({e}) OVER w AS BIGINT) AS {e}" for e in ERRORS)}
    FROM error_grid WINDOW w AS (PARTITION BY machine_id ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


def _since(c: str) -> str:
    return f"coalesce(epoch_us(datetime - max(CASE WHEN comp = '{c}' THEN datetime END) OVER w) / 86400000000.0, 0.0)"


SQL_SINCE = f"""tall AS (
    SELECT machine_id, datetime, 1 AS kind, NULL AS comp FROM telemetry
    UNION ALL SELECT machine_id, datetime, 0, comp FROM maint),
  since AS (SELECT machine_id, datetime, {", ".join(f"last_{c} AS {c}" for c in COMPONENTS)} FROM (
    SELECT machine_id, datetime, kind, {", ".join(
      f"coalesce((epoch_us(datetime) - epoch_us(max(CASE WHEN comp = '{c}' THEN datetime END) OVER w)) / 86400000000.0, 0.0) AS last_{c}"
      for c in COMPONENTS)}
    FROM tall WINDOW w AS (PARTITION BY machine_id ORDER BY datetime, kind
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE kind = 1)"""
SQL_LABELS = "labelled AS (SELECT t.machine_id, t.datetime, " + ", ".join(
    f"CAST(max(CASE WHEN f.failure = '{c}' THEN 1 ELSE 0 END) AS INT) AS risk_{c}" for c in COMPONENTS
) + """ FROM telemetry t LEFT JOIN failures f ON f.machine_id = t.machine_id
    AND f.datetime BETWEEN t.datetime AND t.datetime + INTERVAL 48 HOUR GROUP BY ALL)"""
SQL_MATRIX = f"{SQL_ERROR_FEATURES}, {SQL_SINCE}, {SQL_LABELS}, " + """erp AS (
    SELECT e.*, s.* EXCLUDE (machine_id, datetime), l.* EXCLUDE (machine_id, datetime), m.model, m.age
    FROM error_sums e JOIN since s USING (machine_id, datetime) JOIN labelled l USING (machine_id, datetime)
    LEFT JOIN machines m USING (machine_id))"""
MATRIX_VIEWS = "telemetry errors maint failures machines"
_R = {c: f"round({c}, 6) AS {c}" for c in COMPONENTS}


def rounded(df, cols=COMPONENTS, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("a01_event_counts", "errors", f"{SQL_COUNTS};; SELECT * FROM counts")
def _(v):
    return E.event_counts(v.errors(), KEY, "error_id", ERRORS)


@query("j01_error_join", "telemetry errors", f"{SQL_ERROR_FEATURES};; SELECT * FROM error_grid")
def _(v):
    return E.error_features(grid(v), v.errors(), KEY, "error_id", ERRORS)


_ALL = "machine_id, datetime, " + ", ".join(_R.values())


@query("j02_maintenance_carry", "telemetry maint", f"""{SQL_SINCE};;
  SELECT count(*) AS grid_rows, {", ".join(f"count(*) FILTER ({c} > 0) AS carried_{c}" for c in COMPONENTS)},
    {", ".join(f"round(sum({c}), 3) AS total_{c}" for c in COMPONENTS)} FROM since""")
def _(v):
    """Off-grid maintenance reaches the grid: how many rows it carries into."""
    days = E.days_since(grid(v), v.maint(), TELEMETRY, "comp", COMPONENTS)
    return days.agg(
        F.count("*").alias("grid_rows"),
        *[F.count_if(F.col(c) > 0).alias(f"carried_{c}") for c in COMPONENTS],
        *[F.round(F.sum(c), 3).alias(f"total_{c}") for c in COMPONENTS],
    )


@query("j03_days_since_maint", "telemetry maint", f"{SQL_SINCE};; SELECT {_ALL} FROM since")
def _(v):
    return rounded(E.days_since(grid(v), v.maint(), TELEMETRY, "comp", COMPONENTS))


@query("j03_asof_backward", "telemetry live_metrics", """
  SELECT t.machine_id, t.datetime, m.load_percentage, coalesce(m.event_id, -1) AS metric_id
  FROM telemetry t ASOF LEFT JOIN live_metrics m ON m.machine_id = t.machine_id AND m.updated_at <= t.datetime""")
def _(v):
    """Telemetry with the latest live metric at or before it."""
    right = v.live_metrics().select(
        "machine_id", F.col("updated_at").alias("datetime"), "load_percentage", F.col("event_id").alias("metric_id")
    )
    return E.asof_backward(grid(v), right, TELEMETRY, ["load_percentage", "metric_id"]).na.fill(-1, ["metric_id"])


@query("j04_risk_window_labels", "telemetry failures", f"{SQL_LABELS};; SELECT * FROM labelled")
def _(v):
    return E.risk_window_labels(grid(v), v.failures(), TELEMETRY, "failure", COMPONENTS)


@query("j05_erp_matrix", MATRIX_VIEWS, f"""{SQL_MATRIX};; SELECT machine_id, datetime, {", ".join(ERRORS)},
  {", ".join(_R.values())}, {", ".join(f"risk_{c}" for c in COMPONENTS)}, model, age FROM erp""")
def _(v):
    return rounded(matrix(v))


@query("j06_machine_dimension", MATRIX_VIEWS, f"""{SQL_MATRIX};; SELECT model, age, count(*) AS machine_hours,
  CAST(sum(error1 + error2 + error3 + error4 + error5) AS BIGINT) AS errors_24h,
  CAST(sum(greatest(risk_comp1, risk_comp2, risk_comp3, risk_comp4)) AS BIGINT) AS risky_hours
  FROM erp GROUP BY model, age""")
def _(v):
    return matrix(v).groupBy("model", "age").agg(
        F.count("*").alias("machine_hours"),
        F.sum(sum((F.col(e) for e in ERRORS), F.lit(0))).alias("errors_24h"),
        F.sum(F.greatest(*[f"risk_{c}" for c in COMPONENTS])).cast("long").alias("risky_hours"),
    )


@query("j15_align_by_step", "telemetry ev", """
  a AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY datetime) - 1 AS step FROM telemetry),
  b AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) - 1 AS step FROM ev);;
  SELECT a.machine_id, a.step, a.datetime, a.volt, b.event_id, b.value
  FROM a JOIN b ON a.machine_id = b.machine_id AND a.step = b.step""")
def _(v):
    """k-th telemetry row beside the k-th event of the same machine."""
    a = v.telemetry().select(*KEY, "volt")
    b = v.ev().select("machine_id", "ts", "event_id", "value")
    return E.align_by_step(a, b, TELEMETRY, Series(("machine_id",), ("ts", "event_id"), 7 * DAY), ["machine_id"]).drop("ts")


@query("j16_context_before", "telemetry failures", """
  SELECT machine_id, event_id, datetime, volt, CAST(back AS INT) AS back FROM (
    SELECT f.machine_id, f.event_id, t.datetime, t.volt,
      row_number() OVER (PARTITION BY f.event_id ORDER BY t.datetime DESC) AS back
    FROM failures f JOIN telemetry t ON t.machine_id = f.machine_id AND t.datetime <= f.datetime) WHERE back <= 24""")
def _(v):
    rows = v.telemetry().select(*KEY, "volt")
    return E.context_before(v.failures(), rows, TELEMETRY, 24, ["event_id"])


@query("j17_failure_slice", "telemetry failures", """
  SELECT f.machine_id, f.event_id, f.failure, f.datetime AS failure_ts, t.datetime, t.volt, t.rotate
  FROM failures f JOIN telemetry t ON t.machine_id = f.machine_id
    AND t.datetime BETWEEN f.datetime - INTERVAL 60 HOUR AND f.datetime""")
def _(v):
    rows = v.telemetry().select(*KEY, "volt", "rotate")
    return E.failure_slice(rows, v.failures(), TELEMETRY, 60, ["event_id", "failure"])


@query("j14_orphans", "tickets machines", """
  SELECT ticket_id, machine_id FROM tickets t WHERE machine_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM machines m WHERE m.machine_id = t.machine_id)""")
def _(v):
    return E.orphans(v.tickets().select("ticket_id", "machine_id"), v.machines(), "machine_id")
