"""Feature contributions, their ranking and the reasons shown for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import REASON_AGE, REASON_ERROR, REASON_OTHER, REASON_OVERDUE, REASON_SENSOR


def contributions(features: Column, weights: Column, means: Column, n: int | None = None) -> Column:
    """Additive contributions ``w * (x - mean)`` of a linear risk model; ``n`` is the number of features, if known."""
    if n is not None:
        return F.array(*[F.get(weights, i) * (F.get(features, i) - F.get(means, i)) for i in map(F.lit, range(n))])
    return F.zip_with(weights, F.zip_with(features, means, lambda x, m: x - m), lambda w, d: w * d)


def named(names: Sequence[str], values: Column, features: Column) -> Column:
    """Array of (name, impact, value, position)."""
    n, none = len(names), F.array().cast("array<double>")
    return F.arrays_zip(
        F.array(*[F.lit(x) for x in names]).alias("name"), F.slice(F.coalesce(values, none), 1, n).alias("impact"),
        F.slice(F.coalesce(features, none), 1, n).alias("value"), F.array(*[F.lit(i) for i in range(n)]).alias("position"),
    )


def impact_share(items: Column, n: int | None = None) -> Column:
    """Share of each absolute impact in percent, with a sign of + or -; ``n`` is the number of items of every row, if known.

    Let ``items`` be a column. Shares of a known number are written out, which Spark compiles, the total once. The rest
    stays short: Java compiles no method above 8,000 bytes of code (3,442 for 14 items; 7,550 with the signs written out).
    """
    share = lambda x, total: F.coalesce(F.try_divide(F.abs(x), total) * 100, F.lit(0.0))
    impact = items["impact"]
    if n is None:
        # A lambda computes what it names anew for every item, so it gets the total as a value.
        total = F.array(F.aggregate(impact, F.lit(0.0), lambda a, x: a + F.abs(x)))
        shares = F.transform(total, lambda t: F.transform(impact, lambda x: share(x, t)))[0]
    else:
        sizes = [F.get(impact, F.lit(i)) for i in range(n)]
        total = sum((F.abs(x) for x in sizes), F.lit(0.0))
        shares = F.array(*[share(x, total) for x in sizes])
    return F.arrays_zip(
        items["name"].alias("name"), impact.alias("impact"), items["value"].alias("value"), items["position"].alias("position"),
        shares.alias("share"), F.transform(impact, lambda x: F.when(x > 0, "+").otherwise("-")).alias("sign"),
    )


def top_contributions(items: Column, k: int, positive_only: bool = False) -> Column:
    """The ``k`` largest by absolute impact, ties by position; then only positive ones if asked.

    Sorts inside the row, so there is no shuffle.
    """
    by = F.transform(items["impact"], lambda x: -F.abs(x))
    keyed = F.arrays_zip(by.alias("a"), items["position"].alias("p"), items.alias("x"))
    top = F.slice(F.sort_array(keyed), 1, k)["x"]
    return F.filter(top, lambda x: x["impact"] > 0) if positive_only else top


def _fill(text: str, *parts: Column) -> Column:
    pieces = text.split("{}")
    out = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        out += [part, F.lit(piece)]
    return F.concat(*out)


def reasons(top: Column) -> Column:
    """Short reason per contribution by feature family; one general text when none applies."""

    def reason(x: Column) -> Column:
        name, whole = x["name"], F.format_string("%.0f", F.bround(x["value"], 0))
        return (
            F.when(name.contains("days_comp"), _fill(REASON_OVERDUE, whole))
            .when(name.contains("error"), _fill(REASON_ERROR, F.upper(F.split_part(name, F.lit("_"), F.lit(1))), whole))
            .when(name.contains("GRU_Node"), F.lit(REASON_SENSOR))
            .when(name.contains("age"), _fill(REASON_AGE, whole))
        )

    texts = F.filter(F.transform(top, reason), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(REASON_OTHER)))
