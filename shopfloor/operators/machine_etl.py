"""Feature tables per machine kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import HYDRAULIC_SENSORS, LEAKAGE_PARTS, ROLLING_FEATURES, STEP_MINUTES
from ..functions.arrays import cycle_slope, cycle_stats
from ..functions.scalars import to_number
from .series import Series
from .timeseries import assign_timestamps, days_since_reset, interpolate, ordered_index, rolling_std, usage_counter


def laser_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Temperatures in Celsius and their difference, torque, wear and labels."""
    lens = F.col("`Process temperature [K]`") - 273.15
    source = F.col("`Air temperature [K]`") - 273.15
    wear = F.col("`Tool wear [min]`")
    return df.select(
        *keep,
        lens.alias("lens_temperature_c"),
        source.alias("laser_source_temp_c"),
        (lens - source).alias("delta_temperature"),
        F.col("`Torque [Nm]`").alias("xy_axis_torque_nm"),
        wear.alias("z_axis_tracking_error_proxy"),
        F.col("HDF").alias("target_lens_failure"),
        F.col("OSF").alias("target_gantry_failure"),
        (wear / 20).cast("int").alias("days_since_lens_inspect"),
    )


def robot_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *keep,
        "timestamp",
        F.col("vibration_rms").alias("robot_vibration_g"),
        F.col("temperature_motor").alias("servo_motor_temp_c"),
        F.col("current_phase_avg").alias("robot_torque_proxy_amp"),
        (F.col("rpm") / 100).alias("wire_feed_speed_mmin"),
        F.col("failure_within_24h").alias("target_failure_24h"),
        "hours_since_maintenance",
    )


def punching_features(df: DataFrame) -> DataFrame:
    """Without acoustic columns and wear width; the class as 0/1, NULL when unknown."""
    kept = [c for c in df.columns if "AE_" not in c and c not in ("VB_mm", "Wear_Class")]
    wear = F.col("Wear_Class")
    return df.select(*kept, F.when(wear == "Healthy", 0).when(wear == "Worn", 1).alias("target_wear"))


def drop_leakage(df: DataFrame, parts: Sequence[str] = LEAKAGE_PARTS) -> DataFrame:
    return df.drop(*[c for c in df.columns if any(p in c for p in parts)])


def _or_default(df: DataFrame, name: str, default: float) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def unify_target(df: DataFrame, kind: str, rule: str = "remediation", out: str = "target_risk") -> DataFrame:
    """One 0/1 label per row for a machine kind.

    ``remediation`` treats missing columns and values as healthy; ``audit`` judges the
    accumulator by a lower limit and drops rows without a label.
    """

    def column(name: str, default: float = 0) -> Column:
        return _or_default(df, name, default)

    label = {"punching": "target_wear", "robot": "target_failure_24h"}.get(kind)
    if rule == "remediation":
        if kind == "laser":
            risk = (column("target_lens_failure") > 0) | (column("target_gantry_failure") > 0)
        elif kind == "press_brake":
            # A missing valve or accumulator reading differs from its healthy value.
            risk = (
                ~F.col("target_valve_condition").eqNullSafe(100)
                | F.coalesce(column("target_pump_leakage") > 0, F.lit(False))
                | ~column("target_accumulator_state", 130).eqNullSafe(130)
            )
        else:
            return df.withColumn(out, F.coalesce(to_number(column(label)), F.lit(0)).cast("int"))
        return df.withColumn(out, F.coalesce(risk, F.lit(False)).cast("int"))
    if kind == "laser":
        risk = (F.col("target_lens_failure") != 0) | (F.col("target_gantry_failure") != 0)
    elif kind == "press_brake":
        risk = (
            ~F.col("target_valve_condition").eqNullSafe(100)
            | ~F.col("target_pump_leakage").eqNullSafe(0)
            | F.coalesce(F.col("target_accumulator_state") < 115, F.lit(True))
        )
    else:
        number = to_number(F.col(label))  # a text that is no number is no label
        return df.filter(number.isNotNull()).withColumn(out, number.cast("int"))
    return df.withColumn(out, risk.cast("int"))


def press_brake_features(
    sensors: DataFrame, labels: DataFrame, names: Sequence[str], rates: dict[str, int] | None = None
) -> DataFrame:
    """Cycle statistics of every sensor beside the labels.

    ``sensors`` is long: ``(cycle_id, sensor, samples)``. The arrays shrink to a few numbers
    before the pivot shuffles them. Sensors without rows give NULL columns.
    """
    rates = rates or HYDRAULIC_SENSORS
    stats = sensors.select("cycle_id", "sensor", F.struct(
        *[c.alias(k) for k, c in cycle_stats(F.col("samples"), "s").items()],
        cycle_slope(F.col("samples")).alias("s_slope"),
    ).alias("v"))
    wide = []
    for name in names:
        mine = F.when(F.col("sensor") == name, F.col("v"))
        for stat in ("mean", "max", "std", *(["slope"] if rates.get(name) == 100 else [])):
            wide.append(F.max(mine[f"s_{stat}"]).alias(f"{name.lower()}_{stat}"))
    return labels.join(stats.groupBy("cycle_id").agg(*wide), "cycle_id", "left")


def press_brake_table(sensors: DataFrame, labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Full press brake feature table with cycle times and the filter age."""
    wide = press_brake_features(sensors, labels, names)
    index = F.col("cycle_id")
    return wide.withColumns({
        "timestamp": assign_timestamps(index, "2026-01-01 08:00:00", 1),
        "days_since_oil_filter": days_since_reset(index),
    })


def punching_table(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return usage_counter(punching_features(df), order)


def robot_table(df: DataFrame, s: Series) -> DataFrame:
    """Dropped readings interpolated per series, then projected."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (*s.keys, *s.order)]
    return robot_features(interpolate(df.withColumns({c: F.col(c).cast("double") for c in numeric}), s, numeric), s.keys)


def dedup_by_time(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str]) -> DataFrame:
    """One row per key and time: the first by ``tiebreak``. Combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    first = F.min_by(F.struct(*rest), F.struct(*tiebreak))
    return df.groupBy(*keys, ts).agg(first.alias("_r")).select(*keys, ts, "_r.*")


def remediate(
    df: DataFrame, kind: str, order: Sequence[str], keys: Sequence[str] = (), width: float = 30 * 86_400
) -> DataFrame:
    """Times, one row per time, target, rolling deviations, then no leaking columns."""
    if "timestamp" not in df.columns:
        df = ordered_index(df, order, "_i")
        df = df.withColumn("timestamp", assign_timestamps(F.col("_i"), "2024-01-01 00:00:00", STEP_MINUTES[kind])).drop("_i")
    df = dedup_by_time(df, keys, "timestamp", order)
    df = unify_target(df, kind)
    smooth = [c for c in ROLLING_FEATURES[kind] if c in df.columns]
    df = rolling_std(df, Series(tuple(keys), ("timestamp",), width), smooth)
    df = df.withColumns({f"{c}_roll_std_6": F.coalesce(f"{c}_roll_std_6", F.lit(0.0)) for c in smooth})
    return drop_leakage(df)
