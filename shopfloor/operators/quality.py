"""Declared constraints as checks; each returns the violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def null_violations(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """NULL count per required column, in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in required])))


def history_length(df: DataFrame, keys: Sequence[str], minimums: Sequence[int] = (24, 51)) -> DataFrame:
    """Row count per series and whether it reaches each minimum."""
    n = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return n.withColumns({f"at_least_{m}": F.col("rows") >= m for m in minimums})
