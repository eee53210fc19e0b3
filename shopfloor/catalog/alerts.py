"""Queries of alerts, explanations, the live snapshot and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COMPONENTS, ERRORS, SENSORS
from ..fixtures import EVENTS, TELEMETRY
from ..functions import scalars as S
from ..operators import alerts as A
from ..operators import explain as X
from ..operators import models as M
from ..operators import scaling as SC
from ..operators import windows as W
from ..plans import live as L
from .events import KEY, MATRIX_VIEWS, SQL_MATRIX, grid, stored_matrix
from .profiles import _FIT as SQL_FIT
from .registry import query

# A small fixed linear model per component over 4 sensor means and the 10 state features.
NAMES = [f"GRU_Node_{i}" for i in range(4)] + S.STATE_FEATURES
MEANS = [0.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.1, 0.1, 0.1, 5.0, 5.0, 5.0, 5.0, 10.0]
MODELS = {
    c: ([0.8 - i * 0.3, 0.5, -0.4 + i * 0.2, 0.3] + [0.6 + 0.1 * j for j in range(5)]
        + [0.12 if j == i else 0.02 for j in range(4)] + [0.05], -1.5 + 0.5 * i)
    for i, c in enumerate(COMPONENTS)
}


def components(v):
    return A.build_components(v.machines().select("machine_id", "machine_type"), A.component_catalog(v.spark))


SQL_COMPONENTS = "components AS (SELECT machine_id, machine_type, comp_code, comp_name, baseline_lifespan_days, lower(comp_code) AS comp FROM machines JOIN catalog USING (machine_type))"
SQL_ALERTS = SQL_COMPONENTS + """, alerts AS (SELECT machine_id, comp, comp_name, coalesce(risk, 0) AS risk
  FROM components LEFT JOIN component_risks USING (machine_id, comp))"""
ALERT_VIEWS = "machines catalog component_risks"


def alerts(v):
    return A.component_alerts(components(v), v.component_risks())


@query("o07_build_components", "machines catalog", SQL_COMPONENTS + ";; SELECT machine_id, machine_type, comp_code, comp_name, baseline_lifespan_days FROM components")
def _(v):
    return components(v)


@query("j08_machine_steps", "machines", """SELECT machine_id, t AS datetime FROM machines CROSS JOIN
  (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 1 HOUR)) AS t)""")
def _(v):
    from ..sources.grids import time_grid

    return time_grid(v.machines().select("machine_id"), "2024-01-01 00:00:00", "2024-01-03 00:00:00", 60)


@query("j09_join_with_constant", "machines catalog", SQL_COMPONENTS + """;; SELECT m.machine_id, m.location, c.comp_name FROM machines m
  JOIN components c ON c.machine_id = m.machine_id AND c.comp_code = 'COMP1' WHERE m.machine_id NOT IN (6, 10)""")
def _(v):
    first = components(v).filter("comp_code = 'COMP1'").select("machine_id", "comp_name")
    return v.machines().filter(~F.col("machine_id").isin(6, 10)).select("machine_id", "location").join(first, "machine_id")


@query("j10_scalar_lookups", "machines catalog", SQL_COMPONENTS + """;; SELECT event_id, (SELECT max(machine_id) FROM machines) AS max_machine,
  (SELECT comp_name FROM components WHERE machine_id = 6 AND comp_code = 'COMP1') AS comp_name FROM events""")
def _(v):
    largest = v.machines().agg(F.max("machine_id")).scalar()
    name = A.component_id(components(v), [6], "COMP1").select("comp_name").scalar()
    return v.table("events").select("event_id", largest.alias("max_machine"), name.alias("comp_name"))


@query("j11_component_alerts", ALERT_VIEWS, SQL_ALERTS + ";; SELECT machine_id, comp, comp_name, risk FROM alerts")
def _(v):
    return alerts(v).select("machine_id", "comp", "comp_name", "risk")


@query("j12_latest_metrics", "machines live_metrics", """SELECT machine_id, location, load_percentage, CASE WHEN load_percentage < 50 THEN 1
  WHEN load_percentage < 80 THEN 2 WHEN load_percentage IS NOT NULL THEN 3 ELSE 0 END AS operation_level FROM machines LEFT JOIN (
    SELECT machine_id, arg_max(load_percentage, (updated_at, event_id)) AS load_percentage FROM live_metrics GROUP BY machine_id) USING (machine_id)""")
def _(v):
    latest = W.latest_per_key(metrics(v), ["machine_id"], ["updated_at", "event_id"]).select("machine_id", "load_percentage", "operation_level")
    return v.machines().select("machine_id", "location").join(latest, "machine_id", "left").na.fill(0, ["operation_level"])


def metrics(v):
    return v.live_metrics().withColumn("operation_level", S.operation_level(F.col("load_percentage")))


@query("j13_active_machines", "telemetry", "SELECT DISTINCT machine_id FROM telemetry WHERE datetime = (SELECT max(datetime) FROM telemetry)")
def _(v):
    return A.active_machines(grid(v))


@query("a21_fleet_kpis", ALERT_VIEWS, SQL_ALERTS + """, m AS (SELECT machine_id, max(risk) AS r FROM alerts GROUP BY machine_id);;
  SELECT count(*) AS total, count(*) FILTER (r <= 40) AS safe, count(*) FILTER (r > 40 AND r <= 80) AS warn, count(*) FILTER (r > 80) AS danger FROM m""")
def _(v):
    return A.fleet_kpis(A.worst_component(alerts(v)))


@query("a22_worst_component", ALERT_VIEWS, SQL_ALERTS + """;; SELECT machine_id, max(risk) AS max_risk,
  CASE WHEN max(risk) > 0 THEN arg_max(comp, (risk, -CAST(right(comp, 1) AS INT))) END AS worst_comp FROM alerts GROUP BY machine_id""")
def _(v):
    return A.worst_component(alerts(v))


@query("a24_ticket_status", "tickets", "SELECT status, count(*) AS n FROM tickets GROUP BY status")
def _(v):
    return A.ticket_status(v.tickets())


@query("a25_prediction_quality", "predictions", """SELECT CASE WHEN is_verified_true THEN 'right' WHEN NOT is_verified_true THEN 'wrong' ELSE 'unverified' END AS verdict,
  count(*) AS n FROM predictions GROUP BY 1""")
def _(v):
    return A.prediction_quality(v.predictions())


@query("a27_lifespan_ratio", "machines catalog maint", SQL_COMPONENTS + """;;
  SELECT machine_id, comp, baseline_lifespan_days, round(coalesce((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 86400000000.0, 0), 6) AS days_in_service,
    round(coalesce((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 86400000000.0, 0) / baseline_lifespan_days, 6) AS life_used
  FROM components LEFT JOIN (SELECT machine_id, comp, max(datetime) AS last FROM maint WHERE datetime <= TIMESTAMP '2024-02-01' GROUP BY ALL) USING (machine_id, comp)""")
def _(v):
    out = A.lifespan_ratio(components(v), v.maint(), F.lit("2024-02-01").cast("timestamp_ntz"))
    return out.select(
        "machine_id", "comp", "baseline_lifespan_days", F.round("days_in_service", 6).alias("days_in_service"), F.round("life_used", 6).alias("life_used")
    )


@query("a28_propose_tickets", ALERT_VIEWS + " tickets", SQL_ALERTS + """;; SELECT machine_id, comp, risk FROM alerts a WHERE risk > 80
  AND NOT EXISTS (SELECT 1 FROM tickets t WHERE t.machine_id = a.machine_id AND t.comp = a.comp AND t.status != 'RESOLVED')""")
def _(v):
    return A.propose_tickets(alerts(v).select("machine_id", "comp", "risk"), v.tickets())


@query("j07_lookup_erp", MATRIX_VIEWS, SQL_MATRIX + """;; SELECT f.event_id, e.machine_id AS original_machine_id, e.datetime AS original_datetime,
  round(e.comp1, 6) AS comp1, e.error1, e.age FROM failures f JOIN erp e ON e.machine_id = f.machine_id AND e.datetime = f.datetime""")
def _(v):
    ask = v.failures().select("event_id", F.col("machine_id").alias("original_machine_id"), F.col("datetime").alias("original_datetime"))
    out = L.lookup_erp(ask, stored_matrix(v))
    return out.select("event_id", "original_machine_id", "original_datetime", F.round("comp1", 6).alias("comp1"), "error1", "age")


_VALID = """w AS (SELECT *, count(*) OVER f AS n, count(CASE WHEN volt > 2 THEN volt END) OVER f AS known FROM telemetry
  WINDOW f AS (PARTITION BY machine_id ORDER BY datetime DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("p25_valid_window", "telemetry", """
  r AS (SELECT machine_id, datetime, CASE WHEN volt > 2 THEN volt END AS volt FROM telemetry
    QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY datetime DESC) <= 24);;
  SELECT machine_id, count(volt) = count(*) AS is_valid FROM r GROUP BY machine_id HAVING count(*) >= 2""")
def _(v):
    rows = v.telemetry().select(*KEY, F.when(F.col("volt") > 2, F.col("volt")).alias("volt"))
    packed = W.last_n(rows, ["machine_id"], ["datetime"], ["volt"], 24, 2)
    return packed.select("machine_id", S.valid_window(F.col("rows"), ["volt"], ["datetime"]).alias("is_valid"))


def features(v):
    """Feature vectors of every machine-hour that has 24 rows of history."""
    rows = v.telemetry()
    means = W.bounded(rows, TELEMETRY, 23, 0, lambda w: {
        **{f"m_{c}": F.avg(c).over(w.rowsBetween(-23, 0)) for c in SENSORS}, "n": F.count(F.lit(1)).over(w.rowsBetween(-23, 0))
    }, needs=SENSORS).filter("n = 24")
    p = SC.fit_scaler(rows, SENSORS).select(F.struct("*")).scalar()
    memory = F.array(*[(F.col(f"m_{c}") - p[f"mean_{c}"]) / p[f"std_{c}"] for c in SENSORS])
    return means.select(*KEY, memory.alias("memory"))


def _memory_sql() -> str:
    return SQL_FIT + ", hist AS (SELECT machine_id, datetime, count(*) OVER w AS n, " + ", ".join(f"avg({c}) OVER w AS m_{c}" for c in SENSORS) + \
        """ FROM telemetry WINDOW w AS (PARTITION BY machine_id ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
  mem AS (SELECT machine_id, datetime, """ + ", ".join(f"(m_{c} - mean_{c}) / std_{c} AS z_{c}" for c in SENSORS) + " FROM hist, fit WHERE n = 24)"


_X = ["z_" + c for c in SENSORS] + ERRORS + COMPONENTS + ["age"]
SQL_FEATURES = SQL_MATRIX + ", " + _memory_sql() + ", feat AS (SELECT machine_id, datetime, [" + ", ".join(f"{c}::DOUBLE" for c in _X) + \
    "] AS x, risk_comp1, risk_comp2, risk_comp3, risk_comp4 FROM mem JOIN erp USING (machine_id, datetime))"


def _raw(c: str) -> str:
    w, b = MODELS[c]
    return f"1 / (1 + exp(-({b} + " + " + ".join(f"({x}) * x[{i + 1}]" for i, x in enumerate(w)) + ")))"


def _softened(c: str) -> str:
    p = _raw(c)
    return f"100 * CASE WHEN {p} < 0.5 THEN sqrt({p}) ELSE 1 - sqrt(1 - {p}) END"


@query("m06_training_matrix", MATRIX_VIEWS, SQL_FEATURES + """;; SELECT machine_id, datetime, len(x)::INT AS width, round(list_sum(x), 4) AS total,
  risk_comp1, risk_comp2, risk_comp3, risk_comp4 FROM feat""")
def _(v):
    out = M.training_matrix(features(v), stored_matrix(v), KEY)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select(*KEY, F.size("features").alias("width"), F.round(total, 4).alias("total"), *[f"risk_{c}" for c in COMPONENTS])


@query("m09_linear_scores", MATRIX_VIEWS, SQL_FEATURES + ";; SELECT machine_id, datetime, " + ", ".join(f"round({_softened(c)}, 4) AS {c}" for c in COMPONENTS) + " FROM feat")
def _(v):
    """Softened risk of each component from linear models."""
    rows = M.training_matrix(features(v), stored_matrix(v), KEY)
    p = {c: M.linear_score(F.col("features"), L._floats(w), b) for c, (w, b) in MODELS.items()}
    return rows.select(*KEY, *[F.round(S.soften(x), 4).alias(c) for c, x in p.items()])


_W1 = MODELS["comp1"][0]
SQL_IMPACT = SQL_FEATURES + ", imp AS (SELECT machine_id, datetime, x, [" + ", ".join(
    f"({w}) * (x[{i + 1}] - ({m}))" for i, (w, m) in enumerate(zip(_W1, MEANS))) + "] AS c FROM feat)"


def impacts(v):
    rows = M.training_matrix(features(v), stored_matrix(v), KEY)
    impact = X.contributions(F.col("features"), L._floats(_W1), L._floats(MEANS), len(NAMES))
    return rows.withColumn("impact", impact).select(*KEY, X.named(NAMES, F.col("impact"), F.col("features")).alias("items"))


@query("m11_contributions", MATRIX_VIEWS, SQL_IMPACT + ";; SELECT machine_id, datetime, " + ", ".join(f"round(c[{i + 1}], 4) AS c{i}" for i in range(14)) + " FROM imp")
def _(v):
    return impacts(v).select(*KEY, *[F.round(F.col("items")[i]["impact"], 4).alias(f"c{i}") for i in range(14)])


_NAMED = "['" + "', '".join(NAMES) + "']"
SQL_RANKED = SQL_IMPACT + f""", long AS (SELECT machine_id, datetime, unnest({_NAMED}) AS name, unnest(c) AS impact, unnest(x) AS value,
    unnest(range(14)) AS position FROM imp),
  ranked AS (SELECT *, abs(impact) / sum(abs(impact)) OVER (PARTITION BY machine_id, datetime) * 100 AS share,
    row_number() OVER (PARTITION BY machine_id, datetime ORDER BY abs(impact) DESC, position) AS r FROM long)"""


@query("a23_impact_share", MATRIX_VIEWS, SQL_RANKED + """;; SELECT machine_id, datetime, name, round(share, 4) AS share,
  CASE WHEN impact > 0 THEN '+' ELSE '-' END AS sign FROM ranked WHERE r = 1""")
def _(v):
    shares = impacts(v).withColumn("items", X.impact_share(F.col("items"), len(NAMES)))
    top = X.top_contributions(F.col("items"), 1)
    return shares.withColumn("t", top[0]).select(*KEY, "t.name", F.round("t.share", 4).alias("share"), "t.sign")


@query("w13_top_contributions", MATRIX_VIEWS, SQL_RANKED + ";; SELECT machine_id, datetime, string_agg(name, ',' ORDER BY r) AS top5 FROM ranked WHERE r <= 5 GROUP BY ALL")
def _(v):
    top = X.top_contributions(F.col("items"), 5)
    return impacts(v).select(*KEY, F.array_join(F.transform(top, lambda x: x["name"]), ",").alias("top5"))


_REASON = """CASE WHEN contains(name, 'days_comp') THEN 'Quá hạn (' || round_even(value, 0)::BIGINT || ' ngày)'
  WHEN contains(name, 'error') THEN 'Lỗi ' || upper(name) || ' (x' || round_even(value, 0)::BIGINT || ')'
  WHEN contains(name, 'GRU_Node') THEN 'Dao động cảm biến bất thường' ELSE 'Tuổi thọ cao (' || round_even(value, 0)::BIGINT || ' năm)' END"""


@query("w14_reasons", MATRIX_VIEWS, SQL_RANKED + f""", said AS (SELECT machine_id, datetime, string_agg({_REASON}, '; ' ORDER BY r) AS text
    FROM ranked WHERE r <= 2 AND impact > 0 GROUP BY ALL);;
  SELECT machine_id, datetime, coalesce(text, 'Đa thông số rủi ro') AS text FROM imp LEFT JOIN said USING (machine_id, datetime)""")
def _(v):
    top = X.top_contributions(F.col("items"), 2, positive_only=True)
    return impacts(v).select(*KEY, F.array_join(X.reasons(top), "; ").alias("text"))


def origin_telemetry(v):
    return v.telemetry().withColumns({"original_datetime": F.col("datetime"), "original_machine_id": F.col("machine_id")})


def status(v):
    return L.live_status(
        v.machines(), components(v), metrics(v), L.sensor_windows(origin_telemetry(v)), stored_matrix(v),
        SC.fit_scaler(v.telemetry(), SENSORS), MODELS, NAMES, MEANS,
    )


SQL_STATUS = SQL_FEATURES + ", " + SQL_COMPONENTS + ", now AS (SELECT * FROM feat WHERE datetime = (SELECT max(datetime) FROM telemetry)), risks AS (" + " UNION ALL ".join(
    f"SELECT machine_id, '{c}' AS comp, {_softened(c)} AS risk FROM now" for c in COMPONENTS) + """),
  worst AS (SELECT machine_id, max(coalesce(risk, 0)) AS max_risk, CASE WHEN max(coalesce(risk, 0)) > 0 THEN
    arg_max(comp, (coalesce(risk, 0), -CAST(right(comp, 1) AS INT))) END AS worst_comp FROM components LEFT JOIN risks USING (machine_id, comp) GROUP BY machine_id),
  said AS (SELECT machine_id, string_agg(comp || ' ' || CAST(CAST(round(coalesce(risk, 0)) AS BIGINT) AS VARCHAR), ', ' ORDER BY comp) AS alerts
    FROM components LEFT JOIN risks USING (machine_id, comp) GROUP BY machine_id),
  load AS (SELECT machine_id, arg_max(load_percentage, (updated_at, event_id)) AS load_percentage FROM live_metrics GROUP BY machine_id),
  status AS (SELECT m.machine_id, m.machine_type || ' #' || m.machine_id AS machine_name, m.location, round(max_risk, 4) AS max_risk, worst_comp, load_percentage, alerts,
    CASE WHEN load_percentage < 50 THEN 1 WHEN load_percentage < 80 THEN 2 WHEN load_percentage IS NOT NULL THEN 3 END AS operation_level,
    CASE WHEN max_risk >= 85 THEN 'danger' WHEN max_risk >= 40 THEN 'warning' ELSE 'safe' END AS alert_level
    FROM machines m LEFT JOIN worst USING (machine_id) LEFT JOIN said USING (machine_id) LEFT JOIN load USING (machine_id))"""
STATUS_VIEWS = MATRIX_VIEWS + " catalog live_metrics"


@query("t08_live_status", STATUS_VIEWS, SQL_STATUS + ";; SELECT * FROM status ORDER BY machine_id")
def _(v):
    said = F.transform(F.array_sort(F.map_entries("alerts")), lambda e: F.concat_ws(" ", e["key"], F.round(F.coalesce(e["value"], F.lit(0.0))).cast("long").cast("string")))
    out = status(v).drop("explanations").withColumns({"max_risk": F.round("max_risk", 4), "alerts": F.array_join(said, ", ")})
    return out.orderBy("machine_id")


@query("t08_status_kpis", STATUS_VIEWS, SQL_STATUS + """;; SELECT count(*) AS total, count(*) FILTER (alert_level = 'safe') AS safe,
  count(*) FILTER (alert_level = 'warning') AS warn, count(*) FILTER (alert_level = 'danger') AS danger FROM status""")
def _(v):
    return L.status_kpis(status(v))


@query("t09_replay", MATRIX_VIEWS, SQL_FEATURES + ", risks AS (" + " UNION ALL ".join(
    f"SELECT machine_id, datetime, '{c}' AS comp, {_softened(c)} AS risk FROM feat" for c in COMPONENTS) + """);;
  SELECT f.machine_id, f.event_id, f.failure, r.datetime, r.comp, round(r.risk, 4) AS risk,
    CASE WHEN r.risk > 80 THEN 'danger' WHEN r.risk > 50 THEN 'warning' WHEN r.risk > 20 THEN 'watch' ELSE 'safe' END AS tier
  FROM failures f JOIN risks r ON r.machine_id = f.machine_id AND r.datetime BETWEEN f.datetime - INTERVAL 48 HOUR AND f.datetime""")
def _(v):
    out = L.replay(v.telemetry(), v.failures(), stored_matrix(v), SC.fit_scaler(v.telemetry(), SENSORS), MODELS, TELEMETRY)
    return out.withColumn("tier", S.risk_tier(F.col("risk"), (80, 50, 20))).withColumn("risk", F.round("risk", 4))


SQL_HISTORY = """history AS (SELECT event_id, machine_id, ts, risk, coalesce((risk - lag(risk, 2) OVER (PARTITION BY machine_id ORDER BY ts, event_id)) / 2, 0) AS trend FROM scores),
  shown AS (SELECT event_id, machine_id, ts, risk, round(trend, 6) AS trend, CASE WHEN risk >= 85 THEN 'danger' WHEN risk >= 40 THEN 'warning' ELSE 'safe' END AS alert_level,
    round(CASE WHEN risk >= 85 AND trend > 5 THEN least(100, risk * 1.05::DOUBLE) WHEN risk >= 85 THEN risk WHEN risk >= 40 THEN greatest(40, least(risk, 84))
      WHEN trend > 2 AND risk > 20 THEN least(39, risk * 1.1::DOUBLE) ELSE risk END, 6) AS display_risk FROM history)"""


@query("t04_alert_history", "scores", SQL_HISTORY + ";; SELECT * FROM shown")
def _(v):
    out = L.alert_history(v.scores().drop("label"), EVENTS)
    return out.withColumns({c: F.round(c, 6) for c in ("trend", "display_risk")})


@query("m07_encode_sequences")
def _(v):
    """Memory vectors of every window, with seeded weights."""
    scaled = SC.apply_scaler(v.telemetry(), SC.fit_scaler(v.telemetry(), SENSORS), SENSORS)
    windows = W.sequences(scaled, TELEMETRY, SENSORS, 24)
    return M.encode_sequences(windows, M.encoder_weights(), keep=KEY)


def _trained(v):
    rows = M.training_matrix(features(v), stored_matrix(v), KEY)
    labels = [f"risk_{c}" for c in COMPONENTS]
    return rows, labels, M.train_risk_models(rows, labels)


@query("m08_train_risk_models")
def _(v):
    """Coefficients of the four class-weighted models, one row per model."""
    _, _, models = _trained(v)
    rows = [(label, float(m.intercept), [float(x) for x in m.coefficients]) for label, m in models.items()]
    return v.spark.createDataFrame(rows, "label string, intercept double, weights array<double>")


@query("m09_score_models")
def _(v):
    rows, labels, models = _trained(v)
    return M.score(rows, models, labels).select(*KEY, *[f"risk_score_{c}" for c in labels])


@query("m10_missing_models", MATRIX_VIEWS, SQL_FEATURES + ";; SELECT machine_id, datetime, " + ", ".join(f"0.0::DOUBLE AS risk_score_risk_{c}" for c in COMPONENTS) + ", 4 AS missing FROM feat")
def _(v):
    """Labels without a model score 0 and are named."""
    labels = [f"risk_{c}" for c in COMPONENTS]
    rows = M.score(M.training_matrix(features(v), stored_matrix(v), KEY), {}, labels)
    return rows.select(*KEY, *[f"risk_score_{c}" for c in labels], F.size("model_missing").alias("missing"))


@query("m12_anomaly_score")
def _(v):
    rows = v.memory().withColumnRenamed("memory", "features")
    return M.anomaly_score(rows, F.col("label") == 0, k=8).select("row_id", "label", F.round("anomaly", 8).alias("anomaly"))
