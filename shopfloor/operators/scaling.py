"""Scalers and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_hash
from .timeseries import ordered_index


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation per column; zero deviation becomes 1."""
    mean = [F.avg(c).alias(f"mean_{c}") for c in cols]
    std = [F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"std_{c}") for c in cols]
    return df.agg(*mean, *std)


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardise with stored parameters; ``params`` is a single row."""
    p = params.select(F.struct("*")).scalar()
    return df.withColumns({c: (F.col(c) - p[f"mean_{c}"]) / p[f"std_{c}"] for c in cols})


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0."""
    bounds = df.agg(*[F.min(c).alias(f"_min_{c}") for c in cols], *[F.max(c).alias(f"_max_{c}") for c in cols])
    b = bounds.select(F.struct("*")).scalar()

    def scale(c):
        span = b[f"_max_{c}"] - b[f"_min_{c}"]
        return (F.col(c) - b[f"_min_{c}"]) / F.when(span == 0, 1.0).otherwise(span)

    return df.withColumns({c: scale(c) for c in cols})


def hash_split(df: DataFrame, ids: Sequence[str], test: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Random split that a row keeps under any layout."""
    return df.withColumn(out, stable_hash(*ids, seed=seed) % 10_000 < int(test * 10_000))


def ordered_split(df: DataFrame, order: Sequence[str], share: float = 0.8, out: str = "is_train") -> DataFrame:
    """First ``int(share * n)`` rows of the global order against the rest."""
    numbered = ordered_index(df, order, "_i")
    n = numbered.agg(F.count("*")).scalar()
    return numbered.withColumn(out, F.col("_i") < F.floor(n * share)).drop("_i")


def fit_apply_split(df: DataFrame, order: Sequence[str], cols: Sequence[str], share: float = 0.8) -> DataFrame:
    """Ordered split, scaler fitted on the first part only, applied to both."""
    split = ordered_split(df, order, share)
    return apply_scaler(split, fit_scaler(split.filter("is_train"), cols), cols)


def undersample(df: DataFrame, label: str, ids: Sequence[str], ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Thin out the majority class to about ``ratio`` times the minority; kept rows are fixed by id."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    size = sizes.select(F.struct("*")).scalar()
    major = F.when(size["pos"] > size["neg"], 1).otherwise(0)
    share = ratio * F.least(size["pos"], size["neg"]) / F.greatest(size["pos"], size["neg"])
    lucky = stable_hash(*ids, seed=seed) % 1_000_000 < share * 1_000_000
    return df.filter((F.col(label) != major) | lucky)
