"""Live status of the fleet as one set-based plan, and its replay over past ticks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COMPONENTS, REASON_ABOVE, SENSORS
from ..functions.arrays import array_mean
from ..functions.scalars import hybrid, machine_label, soften, valid_window
from ..operators import alerts as A
from ..operators import explain as X
from ..operators.events import failure_slice
from ..operators.models import STATE_COLUMNS, linear_score
from ..operators.series import Series, bounded
from ..operators.timeseries import risk_trend
from ..operators.windows import last_n, latest_per_key

# A linear risk model per component: weights over the feature vector and an intercept.
LinearModels = Mapping[str, tuple[Sequence[float], float]]


def _floats(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def lookup_erp(scored: DataFrame, erp: DataFrame, key: str = "machine_id", ts: str = "datetime", order: Sequence[str] = ()) -> DataFrame:
    """Rows with the state at exactly their origin machine and time; without a match they drop out.

    Of several states at one machine and time the last by ``order`` wins, then the greatest by value.
    """
    rest = [c for c in erp.columns if c not in (key, ts)]
    last = erp.groupBy(key, ts).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("_state")).select(key, ts, "_state.*")
    state = last.withColumnsRenamed({key: "original_machine_id", ts: "original_datetime"})
    return scored.join(state, ["original_machine_id", "original_datetime"])


def sensor_windows(
    telemetry: DataFrame, n: int = 24, min_rows: int = 2, key: str = "machine_id", ts: str = "datetime"
) -> DataFrame:
    """Last rows of each machine active at the latest tick, validated.

    ``telemetry`` carries ``original_datetime`` and ``original_machine_id``; the newest row's
    origin decides which state is looked up.
    """
    latest = telemetry.agg(F.max(ts)).scalar()
    cols = [*SENSORS, "original_datetime", "original_machine_id"]
    packed = last_n(telemetry, [key], [ts], cols, n, min_rows).filter(F.element_at("rows", -1)[ts] == latest)
    newest = F.element_at("rows", -1)
    return packed.filter(valid_window(F.col("rows"), SENSORS, cols[-2:])).select(
        key, "rows", newest[ts].alias("tick"),
        newest["original_datetime"].alias("original_datetime"), newest["original_machine_id"].alias("original_machine_id"),
    )


def window_means(rows: Column, params: Column) -> Column:
    """Mean of each scaled sensor over a window: the stand-in memory vector of linear models."""
    return F.array(*[
        (array_mean(F.transform(rows, lambda r: r[c])) - params[f"mean_{c}"]) / params[f"std_{c}"] for c in SENSORS
    ])


def score_components(features: DataFrame, models: LinearModels, keys: Sequence[str]) -> DataFrame:
    """Softened risk of every component of every row, long."""
    scores = F.array(*[
        F.struct(F.lit(c).alias("comp"), soften(linear_score(F.col("features"), _floats(w), b)).alias("risk")) for c, (w, b) in models.items()
    ])
    return features.select(*keys, "features", F.inline(scores))


def live_status(
    machines: DataFrame, components: DataFrame, metrics: DataFrame, windows: DataFrame, erp: DataFrame,
    scaler: DataFrame, models: LinearModels, names: Sequence[str], means: Sequence[float],
) -> DataFrame:
    """One row per machine: alerts, worst component, reasons above the danger line, load.

    ``windows`` come from ``sensor_windows``. Machines without a valid window or state get 0.
    """
    params = scaler.select(F.struct("*")).scalar()
    found = lookup_erp(windows.withColumn("memory", window_means(F.col("rows"), params)), erp)
    features = found.select("machine_id", hybrid(F.col("memory"), [F.col(c) for c in STATE_COLUMNS]).alias("features"))
    scored = score_components(features, models, ["machine_id"])
    alerts = A.component_alerts(components, scored)
    worst = A.worst_component(alerts.select("machine_id", "comp", "risk"))
    listed = alerts.groupBy("machine_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("comp", "risk")))).alias("alerts")
    )
    weights = F.create_map(*[x for c, (w, _) in models.items() for x in (F.lit(c), _floats(w))])
    impact = X.contributions(F.col("features"), F.element_at(weights, F.col("worst_comp")), _floats(means))
    top = X.top_contributions(X.named(names, impact, F.col("features")), 2, positive_only=True)
    explained = F.when((F.col("max_risk") > REASON_ABOVE) & F.col("worst_comp").isNotNull(), X.reasons(top))
    load = latest_per_key(metrics, ["machine_id"], ["updated_at", "event_id"]).select("machine_id", "load_percentage", "operation_level")
    return (
        machines.join(listed, "machine_id", "left")
        .join(worst, "machine_id", "left")
        .join(features, "machine_id", "left")
        .join(load, "machine_id", "left")
        .select(
            "machine_id", machine_label(F.col("machine_type"), F.col("machine_id")).alias("machine_name"), "location",
            "alerts", F.coalesce("max_risk", F.lit(0.0)).alias("max_risk"), "worst_comp", explained.alias("explanations"),
            "load_percentage", "operation_level",
            A.alert_level(F.coalesce("max_risk", F.lit(0.0))).alias("alert_level"),
        )
    )


def status_kpis(status: DataFrame) -> DataFrame:
    """Fleet counts by alert level."""
    level = F.col("alert_level")
    return A.fleet_kpis(status, danger=level == "danger", warn=level == "warning")


def alert_history(scores: DataFrame, s: Series, risk: str = "risk") -> DataFrame:
    """Trend, level and shown risk of every tick: the batch twin of the streaming alert state."""
    out = risk_trend(scores, s, risk)
    return out.withColumns({
        "alert_level": A.alert_level(F.col(risk)), "display_risk": A.display_risk(F.col(risk), F.col("trend")),
    })


def replay(
    telemetry: DataFrame, failures: DataFrame, erp: DataFrame, scaler: DataFrame, models: LinearModels, s: Series,
    hours: int = 48, n: int = 24,
) -> DataFrame:
    """Risk of every component at every tick of the ``hours`` before each failure.

    All ticks of all failures are scored in one plan. Ticks with fewer than ``n`` rows of
    history or without a state row are skipped.
    """
    params = scaler.select(F.struct("*")).scalar()
    ts = s.order[0]

    def build(w):
        frame = w.rowsBetween(-(n - 1), 0)
        return {"_n": F.count(F.lit(1)).over(frame), **{f"_m_{c}": F.avg(c).over(frame) for c in SENSORS}}

    history = bounded(telemetry, s, n - 1, 0, build, needs=SENSORS).filter(F.col("_n") == n)
    memory = F.array(*[(F.col(f"_m_{c}") - params[f"mean_{c}"]) / params[f"std_{c}"] for c in SENSORS])
    ticks = failure_slice(history.select(*s.keys, ts, memory.alias("memory")), failures, s, hours, ["event_id", "failure"])
    found = ticks.join(erp.select(*s.keys, ts, *STATE_COLUMNS), [*s.keys, ts])
    features = found.select(
        *s.keys, ts, "event_id", "failure", hybrid(F.col("memory"), [F.col(c) for c in STATE_COLUMNS]).alias("features")
    )
    return score_components(features, models, [*s.keys, ts, "event_id", "failure"]).drop("features")
