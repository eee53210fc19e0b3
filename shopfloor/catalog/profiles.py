"""Queries of profiling, quality checks, evaluation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COMPONENTS, SENSORS
from ..fixtures import SCHEMAS, EVENTS, TELEMETRY
from ..operators import evaluate as EV
from ..operators import events as E
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import scaling as SC
from ..operators import windows as W
from .events import KEY, SQL_LABELS, grid
from .registry import query
from .timeseries import SQL_HASH

ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}
EV_COLS = ["machine_id", "event_type", "value", "k"]


def orders(v):
    return v.table("orders").select(*ORDERS)


def gappy_events(v):
    k = F.col("k")
    return v.ev().select(
        F.when(k % 3 != 0, F.col("value")).alias("value"), F.when(k % 5 != 0, k).alias("k"),
        F.when(k % 2 == 0, F.col("event_type")).alias("event_type"), (F.col("event_type") == "error").cast("int").alias("target_failure"),
    )


SQL_GAPPY = """gappy AS (SELECT CASE WHEN k % 3 != 0 THEN value END AS value, CASE WHEN k % 5 != 0 THEN k END AS k,
  CASE WHEN k % 2 = 0 THEN event_type END AS event_type, CAST(event_type = 'error' AS INT) AS target_failure FROM ev)"""
GAPPY = {"value": "double", "k": "int", "event_type": "string", "target_failure": "int"}


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@query("a05_profile", "ev", SQL_GAPPY + ";; " + _union(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count(DISTINCT {c}) AS \"unique\", count(*) - count({c}) AS missing, "
    f"round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct FROM gappy" for c, t in GAPPY.items()))
def _(v):
    return P.profile(gappy_events(v)).withColumn("missing_pct", F.round("missing_pct", 6))


@query("a06_describe_numeric", "ev", SQL_GAPPY + ";; " + _union(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM gappy"
    for c in ("value", "k", "target_failure")))
def _(v):
    return P.describe_numeric(gappy_events(v)).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_TEXT_SAMPLES = "(SELECT string_agg(e, ', ' ORDER BY e) FROM (SELECT DISTINCT event_type AS e FROM gappy WHERE event_type IS NOT NULL ORDER BY e LIMIT 3))"


@query("a07_audit_profile", "ev", SQL_GAPPY + ";; " + _union(
    [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"unique\", round(min({c})::DOUBLE, 2) AS min, "
     f"round(max({c})::DOUBLE, 2) AS max, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(skewness({c}), 2) AS skew, "
     "NULL::VARCHAR AS samples FROM gappy" for c in ("value", "k", "target_failure")]
    + ["SELECT 'event_type', count(*) - count(event_type), count(DISTINCT event_type), NULL, NULL, NULL, NULL, NULL, " + _TEXT_SAMPLES + " FROM gappy"]))
def _(v):
    return P.audit_profile(gappy_events(v))


@query("a08_value_counts", "ev", SQL_GAPPY + ";; " + _union(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM gappy WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("k", "event_type", "target_failure")))
def _(v):
    return P.value_counts(gappy_events(v), ["k", "event_type", "target_failure"])


_WORDS = " OR ".join(f"contains(lower(c), '{w}')" for w in P.TARGET_PARTS)


@query("a09_label_candidates", "ev", SQL_GAPPY + ", p AS (" + _union(
    f"SELECT '{c}' AS c, count(DISTINCT {c}) AS u FROM gappy" for c in GAPPY) + f""");;
  SELECT c AS "column", u AS "unique", u > 1 AND u < 15 AS few_values, {_WORDS} AS telling_name FROM p WHERE (u > 1 AND u < 15) OR {_WORDS}""")
def _(v):
    return P.label_candidates(gappy_events(v))


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a10_top_correlations", "", "WITH c AS (" + _union(
    f"SELECT '{c}' AS \"column\", round(abs(corr(l_quantity, {c})), 6) AS correlation FROM lineitem" for c in _LINE_NUMBERS)
    + ') SELECT * FROM c ORDER BY correlation DESC, "column" LIMIT 8')
def _(v):
    rows = v.table("lineitem").select(*_LINE_NUMBERS)
    return P.top_correlations(rows, "l_quantity", 8).withColumn("correlation", F.round("correlation", 6))


@query("a11_time_coverage", "ev", """
  g AS (SELECT machine_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY machine_id ORDER BY ts, event_id))) / 1e6 AS gap FROM ev);;
  SELECT machine_id, min(ts) AS first, max(ts) AS last, round(median(gap), 4) AS median_gap_seconds FROM g GROUP BY machine_id""")
def _(v):
    rows = v.ev().select("machine_id", "ts", "event_id")
    return P.time_coverage(rows, EVENTS).withColumn("median_gap_seconds", F.round("median_gap_seconds", 4))


REPORT_TABLES = {
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "orders": {**ORDERS, "o_orderdate": "timestamp_ntz"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "region": {"r_regionkey": "int", "r_name": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "lineitem": {**{c: "bigint" for c in ("l_orderkey", "l_partkey", "l_suppkey")}, "l_linenumber": "int", **{c: "double" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
}


def _report_sql(table: str, c: str, kind: str) -> str:
    opaque = kind.startswith("array")
    lo, hi = (f"'{P.UNSUPPORTED}'",) * 2 if opaque else tuple(f"CAST({f}({c}{' + 0.0' if kind == 'double' else ''}) AS VARCHAR)" for f in ("min", "max"))
    samples = f"'{P.UNSUPPORTED}'" if opaque else (
        f"(SELECT string_agg(CAST(x AS VARCHAR), ', ' ORDER BY x) FROM (SELECT DISTINCT {c} AS x FROM {table} WHERE {c} IS NOT NULL ORDER BY x LIMIT 3))")
    return f"""SELECT '{table}' AS "table", '{c}' AS "column", '{kind}' AS type, count(*) AS rows, count({c}) AS non_null,
      {lo} AS min_value, {hi} AS max_value, {samples} AS sample_values,
      CASE WHEN count(*) = 0 THEN '{P.STATUS_EMPTY}' WHEN count({c}) = 0 THEN '{P.STATUS_ALL_NULL}'
        WHEN count({c}) < count(*) THEN '{P.STATUS_HAS_NULL}' ELSE '{P.STATUS_COMPLETE}' END AS status FROM {table}"""


@query("a12_column_report", "", _union(_report_sql(t, c, k) for t, cols in REPORT_TABLES.items() for c, k in cols.items()))
def _(v):
    return P.column_report({t: v.spark.read.parquet(f"{v.folder}/{t}.parquet").select(*cols) for t, cols in REPORT_TABLES.items()})


TABLES = [*"region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()]


@query("a13_column_count", "", _union(f"SELECT '{t}' AS \"table\", count(*)::INT AS columns FROM (DESCRIBE SELECT * FROM {t})" for t in TABLES))
def _(v):
    return P.column_count(v.spark, {t: v.spark.read.parquet(f"{v.folder}/{t}.parquet") for t in TABLES})


@query("a14_latest_tick", "telemetry", "SELECT max(datetime) AS latest_time, count(*) AS rows, count(*) = 0 AS waiting_data FROM telemetry")
def _(v):
    from ..operators.alerts import latest_tick

    return latest_tick(grid(v), "datetime")


@query("a15_distinct_pairs", "ev", "SELECT DISTINCT machine_id, date_trunc('hour', ts) AS hour FROM ev")
def _(v):
    return v.ev().select("machine_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).dropDuplicates()


@query("a16_label_audit", "scores", """
  s AS (SELECT count(*) AS rows, sum(label)::BIGINT AS failures FROM scores);;
  SELECT rows, rows - failures AS healthy, failures, round(failures / rows, 6) AS rate, rows >= 3000 AS deep_model_allowed,
    CASE WHEN failures / rows < 0.05 THEN 'anomaly_detection' WHEN failures / rows > 0.85 THEN 'reweight_or_undersample' ELSE 'supervised' END AS strategy FROM s""")
def _(v):
    return P.label_audit(v.scores(), "label").withColumn("rate", F.round("rate", 6))


@query("a17_reliability", "ev", """
  o AS (SELECT machine_id, target, CAST(target - lag(target) OVER (PARTITION BY machine_id ORDER BY ts, event_id) = 1 AS INT) AS onset
    FROM (SELECT *, CAST(event_type = 'error' AS INT) AS target FROM ev)),
  a AS (SELECT machine_id, count(*) AS rows, sum(target)::BIGINT AS failing_rows, greatest(coalesce(sum(onset), 0), 1)::BIGINT AS failure_events
    FROM o GROUP BY machine_id HAVING sum(target) > 0),
  m AS (SELECT *, rows * 60 / 60.0::DOUBLE AS total_hours, failing_rows * 60 / 60.0::DOUBLE / failure_events AS mttr_hours,
    (rows - failing_rows) * 60 / 60.0::DOUBLE / failure_events AS mtbf_hours FROM a),
  w AS (SELECT *, greatest(1, CAST(trunc(CASE WHEN total_hours < 50 THEN least(2.0::DOUBLE, total_hours * 0.05::DOUBLE)
    ELSE greatest(4.0::DOUBLE, least(mtbf_hours * 0.15::DOUBLE, 24.0::DOUBLE)) END * 60 / 60) AS INT)) AS window_steps FROM m);;
  SELECT machine_id, rows, failing_rows, failure_events, round(total_hours, 6) AS total_hours, round(mttr_hours, 6) AS mttr_hours,
    round(mtbf_hours, 6) AS mtbf_hours, window_steps, window_steps * 60 / 60.0::DOUBLE AS window_hours FROM w""")
def _(v):
    rows = v.ev().select("machine_id", "ts", "event_id", (F.col("event_type") == "error").cast("int").alias("target"))
    out = P.reliability(rows, EVENTS, "target", 60)
    return out.withColumns({c: F.round(c, 6) for c in ("total_hours", "mttr_hours", "mtbf_hours")})


@query("a18_class_weights", "telemetry failures", SQL_LABELS + ";; " + _union(
    f"SELECT 'risk_{c}' AS label, count(*) FILTER (risk_{c} = 0) AS negatives, count(*) FILTER (risk_{c} = 1) AS positives, "
    f"round(count(*) FILTER (risk_{c} = 0) / count(*) FILTER (risk_{c} = 1), 6) AS weight FROM labelled HAVING count(*) FILTER (risk_{c} = 1) > 0" for c in COMPONENTS))
def _(v):
    labels = E.risk_window_labels(grid(v), v.failures(), TELEMETRY, "failure", COMPONENTS)
    return EV.class_weights(labels, [f"risk_{c}" for c in COMPONENTS]).withColumn("weight", F.round("weight", 6))


@query("a19_roc_auc", "scores", """
  s AS (SELECT risk, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scores GROUP BY risk),
  c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s);;
  SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM c""")
def _(v):
    return EV.roc_auc(v.scores(), "risk", "label").withColumn("auc", F.round("auc", 6))


@query("a20_classification_report", "scores", """
  c AS (SELECT count(*) FILTER (risk >= 50 AND label = 1) AS tp, count(*) FILTER (risk >= 50 AND label = 0) AS fp,
    count(*) FILTER (risk < 50 AND label = 1) AS fn, count(*) FILTER (risk < 50 AND label = 0) AS tn FROM scores),
  r AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS support FROM c
    UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c),
  f AS (SELECT class, p, r, 2 * p * r / (p + r) AS f1, support FROM r),
  a AS (SELECT * FROM f UNION ALL SELECT 'accuracy', (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn), tp + fp + fn + tn FROM c
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f);;
  SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM a""")
def _(v):
    out = EV.classification_report(v.scores(), "risk", "label", 50)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a26_error_metrics", "scores", """SELECT round(avg(abs(risk / 100 - label)), 6) AS mae, round(avg((risk / 100 - label) ** 2), 6) AS mse,
  round(sqrt(avg((risk / 100 - label) ** 2)), 6) AS rmse FROM scores""")
def _(v):
    out = EV.error_metrics(v.scores().withColumn("p", F.col("risk") / 100), "label", "p")
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "mse", "rmse")})


@query("a26_actual_vs_predicted", "scores", """SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) FILTER (label = 1) AS actual,
  count(*) FILTER (risk > 80) AS predicted FROM scores GROUP BY 1""")
def _(v):
    rows = v.scores().withColumns({"was": F.col("label") == 1, "said": F.col("risk") > 80})
    return EV.actual_vs_predicted(rows, "ts", "was", "said", "day")


@query("q01_duplicates", "ev", """SELECT machine_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1""")
def _(v):
    return Q.duplicates(v.ev().withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["machine_id", "hour"])


@query("q02_null_violations", "ev", SQL_GAPPY + ";; " + _union(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM gappy" for c in GAPPY))
def _(v):
    return Q.null_violations(gappy_events(v), list(GAPPY))


@query("q03_referential_violations", "ev machines", """SELECT event_id, machine_id FROM ev WHERE machine_id NOT IN (SELECT machine_id FROM machines)""")
def _(v):
    return E.orphans(v.ev().select("event_id", "machine_id"), v.machines(), "machine_id")


@query("q04_history_length", "ev", """SELECT machine_id, count(*) AS rows, count(*) >= 24 AS at_least_24, count(*) >= 51 AS at_least_51 FROM ev GROUP BY machine_id""")
def _(v):
    return Q.history_length(v.ev(), ["machine_id"])


_FIT = "fit AS MATERIALIZED (SELECT " + ", ".join(f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS std_{c}" for c in SENSORS) + " FROM telemetry)"


@query("m01_fit_scaler", "telemetry", _FIT + ";; SELECT " + ", ".join(f"round(mean_{c}, 8) AS mean_{c}, round(std_{c}, 8) AS std_{c}" for c in SENSORS) + " FROM fit")
def _(v):
    out = SC.fit_scaler(v.telemetry(), SENSORS)
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query("m02_apply_scaler", "telemetry", _FIT + ";; SELECT machine_id, datetime, " + ", ".join(f"round(({c} - mean_{c}) / std_{c}, 6) AS {c}" for c in SENSORS) + " FROM telemetry CROSS JOIN fit")
def _(v):
    rows = v.telemetry()
    out = SC.apply_scaler(rows, SC.fit_scaler(rows, SENSORS), SENSORS)
    return out.withColumns({c: F.round(c, 6) for c in SENSORS})


_SPLIT = """split AS (SELECT *, row_number() OVER (ORDER BY machine_id, datetime) - 1 < floor(0.8 * (SELECT count(*) FROM telemetry)) AS is_train FROM telemetry)"""


@query("w12_ordered_split", "telemetry", _SPLIT + ";; SELECT machine_id, datetime, is_train FROM split")
def _(v):
    return SC.ordered_split(grid(v), ["machine_id", "datetime"])


@query("m03_fit_apply_split", "telemetry", _SPLIT + ", fit AS (SELECT " + ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in SENSORS)
       + " FROM split WHERE is_train);; SELECT machine_id, datetime, is_train, " + ", ".join(f"round(({c} - mean_{c}) / std_{c}, 6) AS {c}" for c in SENSORS) + " FROM split, fit")
def _(v):
    out = SC.fit_apply_split(v.telemetry(), ["machine_id", "datetime"], SENSORS)
    return out.withColumns({c: F.round(c, 6) for c in SENSORS})


@query("m04_minmax", "telemetry", "SELECT machine_id, datetime, " + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in SENSORS) + " FROM telemetry")
def _(v):
    return SC.minmax(v.telemetry(), SENSORS).withColumns({c: F.round(c, 6) for c in SENSORS})


@query("m05_hash_split", "", f"SELECT event_id, {SQL_HASH('event_id', 42)} % 10000 < 2000 AS is_test FROM events")
def _(v):
    return SC.hash_split(v.table("events").select("event_id"), ["event_id"])


@query("m13_undersample", "scores", f"""
  s AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores);;
  SELECT event_id, label FROM scores, s WHERE label != CASE WHEN pos > neg THEN 1 ELSE 0 END
    OR {SQL_HASH('event_id', 42)} % 1000000 < 1.0::DOUBLE * least(pos, neg) / greatest(pos, neg) * 1000000""")
def _(v):
    return SC.undersample(v.scores().select("event_id", "label"), "label", ["event_id"])


@query("w09_latest_per_key", "live_metrics", """SELECT machine_id, event_id, load_percentage, updated_at FROM live_metrics
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY updated_at DESC, event_id DESC) = 1""")
def _(v):
    return W.latest_per_key(v.live_metrics(), ["machine_id"], ["updated_at", "event_id"])


@query("w10_last_n", "telemetry", """
  r AS (SELECT * FROM telemetry WHERE datetime <= TIMESTAMP '2024-01-20'
    QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY datetime DESC) <= 24);;
  SELECT machine_id, count(*)::INT AS n, min(datetime) AS oldest, max(datetime) AS newest, arg_min(volt, datetime) AS first_volt,
    arg_max(volt, datetime) AS last_volt FROM r GROUP BY machine_id HAVING count(*) >= 24""")
def _(v):
    until = F.lit("2024-01-20").cast("timestamp_ntz")
    out = W.last_n(v.telemetry(), ["machine_id"], ["datetime"], ["volt"], 24, 24, until)
    rows = F.col("rows")
    first, last = rows[0], F.element_at(rows, -1)
    return out.select(
        "machine_id", F.size(rows).alias("n"), first["datetime"].alias("oldest"), last["datetime"].alias("newest"),
        first["volt"].alias("first_volt"), last["volt"].alias("last_volt"),
    )


@query("w11_sequences", "telemetry", """
  s AS (SELECT machine_id, datetime, list([volt, rotate, pressure, vibration]) OVER w AS win, row_number() OVER (PARTITION BY machine_id ORDER BY datetime) AS n
    FROM telemetry WINDOW w AS (PARTITION BY machine_id ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW));;
  SELECT machine_id, datetime, len(win)::INT AS n, round(list_sum(list_transform(win, lambda x, i: x[1] * i)), 4) AS volt_digest,
    round(list_sum(list_transform(win, lambda x, i: x[2] * i)), 2) AS rotate_digest, round(list_sum(list_transform(win, lambda x, i: x[3] * i)), 4) AS pressure_digest,
    round(list_sum(list_transform(win, lambda x, i: x[4] * i)), 4) AS vibration_digest
  FROM s WHERE n >= 24""")
def _(v):
    """Windows shown by their length and position-weighted sums per sensor."""
    out = W.sequences(v.telemetry(), TELEMETRY, SENSORS, 24)

    def digest(at):
        weighted = F.transform("window", lambda x, i: x[at] * (i + 1))
        return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)

    return out.select(
        *KEY, F.size("window").alias("n"), F.round(digest(0), 4).alias("volt_digest"),
        F.round(digest(1), 2).alias("rotate_digest"), F.round(digest(2), 4).alias("pressure_digest"), F.round(digest(3), 4).alias("vibration_digest"),
    )


@query("o01_multi_key_sort", "ev", "SELECT machine_id, ts, event_id, value FROM ev ORDER BY machine_id, ts, event_id")
def _(v):
    return v.ev().select("machine_id", "ts", "event_id", "value").orderBy("machine_id", "ts", "event_id")


@query("o02_latest_rows", "ev", "SELECT event_id, ts, value FROM ev WHERE machine_id = 5 ORDER BY ts DESC LIMIT 24")
def _(v):
    return v.ev().filter("machine_id = 5").select("event_id", "ts", "value").orderBy(F.desc("ts")).limit(24)


@query("o03_top_k", "ev", "SELECT event_id, value FROM ev ORDER BY value DESC, event_id LIMIT 8")
def _(v):
    return v.ev().select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(8)


@query("o04_sample_values", "", _union(
    f"SELECT '{c}' AS \"column\", (SELECT string_agg(CAST(x AS VARCHAR), ', ' ORDER BY x) FROM (SELECT DISTINCT {c} AS x FROM orders ORDER BY x LIMIT 3)) AS samples"
    for c in ORDERS))
def _(v):
    return P.sample_values(orders(v), list(ORDERS))


@query("o06_seeded_pick", "failures", f"""SELECT machine_id, event_id, datetime, failure FROM failures
  QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY {SQL_HASH('event_id', 3)}, event_id) = 1""")
def _(v):
    return W.seeded_pick(v.failures(), ["machine_id"], ["event_id"], 3)
