"""Helpers the text operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space; null or blank text has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.array_remove(F.split(bare, SPACE, -1), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas, where Spark would repeat it for every element."""
    return F.transform(F.array(value), body)[0]


def require(df: DataFrame, *names: str) -> None:
    """Fail early on a missing column; a clash or an extra column is the caller's to keep."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, and a collection of the driver's garbage behind it.

    Spark deletes the files of a shuffle once the driver has collected the objects that stood for it. A job that goes on for
    many steps would else keep them all.
    """
    out = materialize(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
