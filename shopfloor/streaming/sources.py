"""Streaming sources and event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Parquet folder as a stream; a file limit, if given, bounds every micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def telemetry_stream(stream: DataFrame, payload: str = "sensor_payload", fields: str | None = None) -> DataFrame:
    """Raw telemetry with its payload parsed once into typed columns."""
    from ..schemas import PAYLOAD

    parsed = F.from_json(payload, fields or PAYLOAD).alias("_p")
    return stream.select("*", parsed).select(*[c for c in stream.columns if c != payload], "_p.*")


def with_event_time(stream: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Event time with a watermark; repeated (key, time) rows dropped within it."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark([*keys, ts])
