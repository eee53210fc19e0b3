"""Time grids and keyed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_grid(machines: DataFrame, start: str, end: str, minutes: int, out: str = "datetime") -> DataFrame:
    """Every machine at every step of ``[start, end]``.

    The steps are generated on each machine's row: a map-side expansion without a join. The
    step count depends only on the bounds.
    """
    steps = F.expr(
        f"sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{end}', INTERVAL '{minutes}' MINUTE)"
    )
    return machines.withColumn(out, F.explode(steps))


def scan_machine(df: DataFrame, key: str, value, ts: str, until: str) -> DataFrame:
    """Rows of one key up to a time; both predicates reach the scan."""
    bound = F.lit(until).cast(df.schema[ts].dataType)
    return df.filter((F.col(key) == value) & (F.col(ts) <= bound))
