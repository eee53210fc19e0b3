"""Event counts, as-of and interval operators between a time grid and event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import SLICE, Series, carry, ordinal, position, running_sum, with_slice


def event_counts(df: DataFrame, keys: Sequence[str], cat: str, values: Sequence[str]) -> DataFrame:
    """One row per key with a count column per category value; the value list fixes the schema."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(cat) == v).alias(v) for v in values])


def error_features(grid: DataFrame, errors: DataFrame, keys: Sequence[str], cat: str, values: Sequence[str]) -> DataFrame:
    """Grid rows with the event counts at exactly their time, 0 without events."""
    counts = event_counts(errors, keys, cat, values)
    return grid.join(counts, list(keys), "left").na.fill(0, list(values))


def days_since(
    grid: DataFrame, events: DataFrame, s: Series, cat: str, values: Sequence[str], flag_never: bool = False
) -> DataFrame:
    """Days since the last event of each category at or before the grid time, else 0.

    Events count at equal time, also off the grid. ``flag_never`` adds ``never_<value>``.
    """
    ts = s.order[0]
    tall = grid.withColumn("_kind", F.lit(1)).unionByName(
        events.select(
            *s.keys, ts, F.lit(0).alias("_kind"),
            *[F.when(F.col(cat) == v, F.col(ts)).alias(f"_at_{v}") for v in values],
        ),
        allowMissingColumns=True,
    )
    ordered = Series(s.keys, (ts, "_kind"), s.width)
    seen = carry(tall, ordered, {f"_last_{v}": f"_at_{v}" for v in values}).filter("_kind = 1")
    columns = {v: F.coalesce(elapsed_days(f"_last_{v}", ts), F.lit(0.0)) for v in values}
    if flag_never:
        columns |= {f"never_{v}": F.col(f"_last_{v}").isNull() for v in values}
    return seen.withColumns(columns).drop("_kind", *[f"_at_{v}" for v in values], *[f"_last_{v}" for v in values])


def elapsed_days(start: str, end: str):
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(86_400_000_000.0)


def asof_backward(left: DataFrame, right: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Left rows with the values of the last right row at or before their time."""
    kind = "_kind"
    at = F.struct(*[F.col(c) for c in cols])
    tall = left.withColumn(kind, F.lit(1)).unionByName(
        right.select(*s.keys, *s.order, F.lit(0).alias(kind), at.alias("_row")), allowMissingColumns=True
    )
    ordered = Series(s.keys, (s.order[0], kind, *s.order[1:]), s.width)
    return (
        carry(tall, ordered, {"_found": "_row"})
        .filter(F.col(kind) == 1)
        .withColumns({c: F.col("_found")[c] for c in cols})
        .drop(kind, "_row", "_found")
    )


def announce(events: DataFrame, s: Series, seconds: int) -> DataFrame:
    """Copies of each event in every slice touched by the span of ``seconds`` before it.

    ``_from`` is the start of the span; in later slices it sorts before all rows.
    """
    ts = s.order[0]
    when = position(events, ts)
    width = F.lit(float(s.width))
    touched = F.sequence(F.floor((when - seconds) / width), F.floor(when / width))
    return events.withColumns({SLICE: F.explode(touched), "_from": F.col(ts) - F.expr(f"INTERVAL '{seconds}' SECOND")})


def risk_window_labels(
    grid: DataFrame, failures: DataFrame, s: Series, cat: str, values: Sequence[str], hours: int = 48
) -> DataFrame:
    """``risk_<value>`` = 1 iff a failure of that kind lies in ``[t, t + hours]``, ends included.

    No range join: each failure is announced at the start of its warning span, and a row is
    at risk while the latest failure announced before it still lies ahead.
    """
    ts = s.order[0]
    warned = announce(failures, s, hours * 3600).select(
        *s.sliced, F.col("_from").alias(ts), F.lit(0).alias("_kind"),
        *[F.when(F.col(cat) == v, F.col(ts)).alias(f"_at_{v}") for v in values],
    )
    tall = with_slice(grid, s).withColumn("_kind", F.lit(1)).unionByName(warned, allowMissingColumns=True)
    so_far = f"over (partition by {', '.join(s.sliced)} order by {ts}, _kind rows between unbounded preceding and current row)"
    out = tall.withColumns({f"_next_{v}": F.expr(f"max(_at_{v}) {so_far}") for v in values}).filter("_kind = 1")
    labels = {f"risk_{v}": F.expr(f"cast(coalesce(_next_{v} >= {ts}, false) as int)") for v in values}
    return out.withColumns(labels).drop(
        SLICE, "_kind", *[f"_at_{v}" for v in values], *[f"_next_{v}" for v in values]
    )


def align_by_step(a: DataFrame, b: DataFrame, sa: Series, sb: Series, on: Sequence[str]) -> DataFrame:
    """Join the k-th row of one series to the k-th row of another; ``on`` are shared key columns."""
    return ordinal(a, sa, "step").join(ordinal(b, sb, "step"), [*on, "step"])


def context_before(events: DataFrame, rows: DataFrame, s: Series, n: int, event_cols: Sequence[str]) -> DataFrame:
    """The last ``n`` rows at or before each event, with ``event_cols`` and ``back`` (1 = newest).

    An event finds its place by a running count, then its rows by an equi-join on position:
    no event is paired with rows outside its context.
    """
    ts = s.order[0]
    tall = rows.select(*s.keys, ts, F.lit(0).alias("_kind"), F.lit(1).alias("_one")).unionByName(
        events.select(*s.keys, ts, F.lit(1).alias("_kind"), F.lit(0).alias("_one"), *[F.col(c).alias(f"_e_{c}") for c in event_cols]),
        allowMissingColumns=True,
    )
    placed = running_sum(tall, Series(s.keys, (ts, "_kind"), s.width), {"_seen": "_one"}).filter("_kind = 1")
    wanted = placed.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(
        *s.keys, (F.col("_seen") - F.col("back")).alias("_at"), "back", *[F.col(f"_e_{c}").alias(c) for c in event_cols]
    )
    return ordinal(rows, s, "_at").join(wanted.filter("_at >= 0"), [*s.keys, "_at"]).drop("_at")


def failure_slice(rows: DataFrame, failures: DataFrame, s: Series, hours: int, failure_cols: Sequence[str]) -> DataFrame:
    """Rows within ``[failure - hours, failure]`` of the failing key, one copy per failure.

    The range join runs on equal key and day: a failure is copied to the days it covers.
    """
    ts = s.order[0]
    day = 86_400
    span = hours * 3600
    when = position(failures, ts)
    covered = failures.select(
        *s.keys, F.col(ts).alias("_failure_ts"), *failure_cols,
        F.explode(F.sequence(F.floor((when - span) / day), F.floor(when / day))).alias("_day"),
    )
    lag = F.timestamp_diff("MICROSECOND", F.col(ts), F.col("_failure_ts"))
    return (
        rows.withColumn("_day", F.floor(position(rows, ts) / day))
        .join(covered, [*s.keys, "_day"])
        .filter((lag >= 0) & (lag <= span * 1_000_000))
        .drop("_day")
        .withColumnRenamed("_failure_ts", "failure_ts")
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key is set but missing in the parent."""
    keys = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")
