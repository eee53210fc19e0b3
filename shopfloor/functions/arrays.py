"""Row-wise statistics of sample arrays, without exploding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def array_mean(values: Column) -> Column:
    known = present(values)
    return F.when(F.size(known) > 0, array_sum(known) / F.size(known))


def array_std(values: Column) -> Column:
    """Sample deviation, NULL with fewer than two values."""
    known = present(values)
    n = F.size(known)
    mean = array_mean(values)
    squares = F.transform(known, lambda x: (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(array_sum(squares) / (n - 1)))


def cycle_stats(samples: Column, prefix: str) -> dict[str, Column]:
    """Mean, maximum and sample deviation of a cycle."""
    return {
        f"{prefix}_mean": array_mean(samples),
        f"{prefix}_max": F.array_max(samples),
        f"{prefix}_std": array_std(samples),
    }


def cycle_slope(samples: Column, n: int = 1000) -> Column:
    """Mean of the differences between neighbours among the first ``n`` samples, gaps skipped."""
    head = F.slice(samples, 1, n)
    later = F.slice(samples, 2, n - 1)
    # The shorter side of zip_with is padded with NULL, which the mean skips.
    return array_mean(F.zip_with(later, head, lambda b, a: b - a))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))
