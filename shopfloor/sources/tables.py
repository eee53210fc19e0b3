"""Writers and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_time_table(df: DataFrame, path: str, key: str, ts: str, mode: str = "overwrite") -> None:
    """Table partitioned by date, files sorted by key and time.

    Range partitioning on (date, key, time) keeps files of one size even on a day or machine
    with most of the rows, and gives each file narrow key and time bounds for skipping.
    """
    dated = df.withColumn("event_date", F.to_date(ts))
    order = ["event_date", key, ts]
    dated.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("event_date").parquet(path)


def read_time_table(spark: SparkSession, path: str, ts: str, start: str, end: str) -> DataFrame:
    """Rows within ``[start, end]``; the dates also prune partitions."""
    df = spark.read.parquet(path)
    kind = df.schema[ts].dataType
    lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
    return df.filter(F.col("event_date").between(F.to_date(lo), F.to_date(hi)) & F.col(ts).between(lo, hi)).drop("event_date")


def reset_table(spark: SparkSession, path: str) -> None:
    """Drop all rows, keep the schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
