"""Column expressions: scores, tiers, times, JSON, text and NULL handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MEMORY_SIZE, STATE_FEATURES, TIER_CUTS


def soften(p: Column) -> Column:
    """Probability pulled towards the middle, in percent. Not monotone at 0.5."""
    return F.when(p < 0.5, F.sqrt(p)).otherwise(1 - F.sqrt(1 - p)) * 100


def risk_tier(risk: Column, cuts: Sequence[float] = TIER_CUTS) -> Column:
    """Class of a risk in percent; every cut is exclusive. Two cuts leave out the watch class."""
    names = ["danger", "warning", "watch"][: len(cuts)]
    tier = None
    for name, cut in zip(names, cuts):
        tier = F.when(risk > cut, name) if tier is None else tier.when(risk > cut, name)
    return tier.otherwise("safe")


def operation_level(load: Column) -> Column:
    """1 below 50 percent load, 2 below 80, else 3."""
    return F.when(load < 50, 1).when(load < 80, 2).otherwise(3)


def load_bar(load: Column) -> Column:
    """Display class of a load bar, cut at 40 and 80 percent."""
    return F.when(load > 80, "high").when(load > 40, "medium").otherwise("low")


def binarize(value: Column, threshold: float = 100) -> Column:
    """1 below the threshold, 0 otherwise; NULL counts as not below."""
    return F.coalesce((value < threshold).cast("int"), F.lit(0))


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def shift_time(df: DataFrame, ts: str, event: Column, anchor: Column) -> DataFrame:
    """Move a series so that ``event`` falls on ``anchor``; keeps ``original_datetime``."""
    return df.withColumn("original_datetime", F.col(ts)).withColumn(ts, F.col(ts) + (anchor - event))


def elapsed(start: Column, end: Column, unit: str = "days") -> Column:
    """Fractional days or hours between two times."""
    micros = {"days": 86_400_000_000.0, "hours": 3_600_000_000.0}[unit]
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(micros)


def parse_time(text: Column) -> Column:
    """ISO text to a time without zone; NULL when it cannot be read."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def to_payload(cols: Sequence[str]) -> Column:
    """Typed columns as one JSON text."""
    return F.to_json(F.struct(*cols))


def payload_get(payload: Column, fields: dict[str, T.DataType]) -> Column:
    """Struct of the named JSON fields; the text is parsed once for all of them."""
    return F.from_json(payload, T.StructType([T.StructField(k, t) for k, t in fields.items()]))


def to_number(value: Column) -> Column:
    """Text as a number, NULL when it is none."""
    return value.cast("string").try_cast("double")


def machine_label(kind: Column, machine_id: Column) -> Column:
    return F.concat(kind, F.lit(" #"), machine_id.cast("string"))


def valid_window(rows: Column, sensors: Sequence[str], origin: Sequence[str]) -> Column:
    """A window (array of structs, oldest first) whose sensors are all set and whose oldest
    row names its origin."""
    gap = F.exists(rows, lambda r: _any_null(r, sensors))
    oldest = rows[0]
    return ~gap & ~_any_null(oldest, origin)


def _any_null(row: Column, fields: Sequence[str]) -> Column:
    test = F.lit(False)
    for f in fields:
        test = test | row[f].isNull()
    return test


def hybrid(memory: Column, state: Sequence[Column]) -> Column:
    """Memory vector followed by the state features."""
    return F.concat(memory, F.array(*[c.cast("double") for c in state]))


def feature_names(memory: int = MEMORY_SIZE) -> list[str]:
    return [f"GRU_Node_{i}" for i in range(memory)] + STATE_FEATURES


def stable_hash(*cols: str | Column, seed: int = 0) -> Column:
    """Non-negative 60-bit hash that is the same on every engine and layout."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column, so that statistics skip it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
