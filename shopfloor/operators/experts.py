"""Routing of machine types to their model settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EXPERTS

REGISTRY_SCHEMA = """machine_type string, kind string, dynamic_cols array<string>, static_cols array<string>,
    target_col string, time_steps int, lookahead int, batch_size int, risk_threshold double"""


def expert_registry(spark: SparkSession) -> DataFrame:
    fields = [f.strip().split()[0] for f in REGISTRY_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(e[f] for f in fields) for e in EXPERTS], REGISTRY_SCHEMA)


def route(df: DataFrame, registry: DataFrame, on: str = "machine_type") -> DataFrame:
    """Rows with the settings of their machine type; the registry has one row per type."""
    return df.join(F.broadcast(registry), on, "left")
