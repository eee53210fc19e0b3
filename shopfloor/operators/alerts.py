"""Alerts, KPIs and tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import COMPONENT_CATALOG, DANGER_AT, REASON_ABOVE, WARNING_AT


def component_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        COMPONENT_CATALOG, "machine_type string, comp_code string, comp_name string, baseline_lifespan_days int"
    )


def build_components(machines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Components of every machine, from the 16-row catalog of its type."""
    return machines.join(F.broadcast(catalog), "machine_type")


def component_alerts(components: DataFrame, scores: DataFrame) -> DataFrame:
    """A risk for every component of every machine, 0 without a score.

    Component codes meet score names in lower case.
    """
    left = components.withColumn("comp", F.lower("comp_code"))
    return left.join(scores, ["machine_id", "comp"], "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))


def worst_component(alerts: DataFrame) -> DataFrame:
    """Highest risk and its component per machine; ties go to the lower code, no risk to NULL."""
    top = F.max_by("comp", F.struct("risk", -F.substring("comp", 5, 3).cast("int")))
    out = alerts.groupBy("machine_id").agg(F.max("risk").alias("max_risk"), top.alias("_top"))
    return out.withColumn("worst_comp", F.when(F.col("max_risk") > 0, F.col("_top"))).drop("_top")


def fleet_kpis(alerts: DataFrame, risk: str = "max_risk", danger: Column | None = None, warn: Column | None = None) -> DataFrame:
    """Machines in total and by class: above 80 danger, above 40 warning, the rest safe."""
    r = F.col(risk)
    danger = (r > 80) if danger is None else danger
    warn = ((r > 40) & (r <= 80)) if warn is None else warn
    out = alerts.agg(
        F.count("*").alias("total"), F.count_if(danger).alias("danger"), F.count_if(warn).alias("warn")
    )
    return out.withColumn("safe", F.col("total") - F.col("danger") - F.col("warn"))


def alert_level(risk: Column) -> Column:
    return F.when(risk >= DANGER_AT, "danger").when(risk >= WARNING_AT, "warning").otherwise("safe")


def display_risk(risk: Column, trend: Column) -> Column:
    """Risk as shown: pushed up while rising, kept inside the band of its level."""
    rising_danger = F.least(F.lit(100.0), risk * 1.05)
    in_warning = F.greatest(F.lit(WARNING_AT), F.least(risk, F.lit(DANGER_AT - 1)))
    rising_safe = F.least(F.lit(WARNING_AT - 1), risk * 1.1)
    return (
        F.when((risk >= DANGER_AT) & (trend > 5), rising_danger)
        .when(risk >= DANGER_AT, risk)
        .when(risk >= WARNING_AT, in_warning)
        .when((trend > 2) & (risk > 20), rising_safe)
        .otherwise(risk)
    )


def active_machines(telemetry: DataFrame, key: str = "machine_id", ts: str = "datetime") -> DataFrame:
    """Machines with a row at the latest tick of the whole table."""
    latest = telemetry.agg(F.max(ts)).scalar()
    return telemetry.filter(F.col(ts) == latest).select(key).distinct()


def latest_tick(df: DataFrame, ts: str) -> DataFrame:
    """Latest time, row count and whether the table still waits for data."""
    return df.agg(F.max(ts).alias("latest_time"), F.count("*").alias("rows")).withColumn("waiting_data", F.col("rows") == 0)


def ticket_status(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("status").agg(F.count("*").alias("n"))


def prediction_quality(predictions: DataFrame) -> DataFrame:
    verdict = F.when(F.col("is_verified_true"), "right").when(~F.col("is_verified_true"), "wrong").otherwise("unverified")
    return predictions.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def lifespan_ratio(components: DataFrame, maint: DataFrame, at: Column) -> DataFrame:
    """Days in service against the expected lifespan of each component; never replaced gives 0."""
    last = maint.filter(F.col("datetime") <= at).groupBy("machine_id", "comp").agg(F.max("datetime").alias("replaced_at"))
    joined = components.withColumn("comp", F.lower("comp_code")).join(last, ["machine_id", "comp"], "left")
    days = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("replaced_at"), at) / F.lit(86_400_000_000.0), F.lit(0.0))
    return joined.withColumn("days_in_service", days).withColumn(
        "life_used", F.col("days_in_service") / F.col("baseline_lifespan_days")
    )


def propose_tickets(alerts: DataFrame, tickets: DataFrame, above: float = REASON_ABOVE) -> DataFrame:
    """Components above the danger line without an open ticket."""
    open_tickets = tickets.filter(F.col("status") != "RESOLVED").select("machine_id", "comp").distinct()
    return alerts.filter(F.col("risk") > above).join(open_tickets, ["machine_id", "comp"], "left_anti")


def component_id(components: DataFrame, machine_ids: Sequence[int], code: str) -> DataFrame:
    """Component rows of some machines by code, as lookups by (machine, code)."""
    return components.filter(F.col("machine_id").isin(*machine_ids) & (F.col("comp_code") == code))
