"""Feature and label matrix per machine-hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMPONENTS, ERRORS, RISK_HOURS
from ..operators.events import announce, event_counts
from ..operators.series import SLICE, Series, _border_rows, with_slice


def erp_matrix(
    grid: DataFrame,
    errors: DataFrame,
    maint: DataFrame,
    failures: DataFrame,
    machines: DataFrame,
    s: Series,
    hours: int = RISK_HOURS,
    rolling_rows: int = 24,
) -> DataFrame:
    """Error sums, days since replacement, failure labels and machine attributes per grid row.

    The separate operators (``rolling_sum``, ``days_since``, ``risk_window_labels``) are fused:
    grid rows, events and what neighbouring slices contribute meet in one exchange on
    (machine, slice), where every window runs on the same sort.
    """
    ts = s.order[0]
    keys = list(s.keys)
    by = ", ".join(s.sliced)
    span = hours * 3600
    rows = with_slice(grid.select(*keys, ts), s)
    counts = event_counts(errors, [*keys, ts], "error_id", ERRORS)

    # Border rows are found on the bare grid and get their counts afterwards.
    border = _border_rows(rows, s, rolling_rows - 1, True)
    counted = rows.selectExpr("*", "false as _copy").unionByName(border.selectExpr("*", "true as _copy"))
    counted = counted.join(counts, [*keys, ts], "left").withColumn("_kind", F.lit(1))

    replaced = with_slice(
        maint.selectExpr(*keys, ts, *[f"case when comp = '{c}' then {ts} end as _at_{c}" for c in COMPONENTS]), s
    )
    # Last replacement before each slice, from one row per (machine, slice).
    earlier = f"over (partition by {', '.join(keys)} order by {SLICE} rows between unbounded preceding and 1 preceding)"
    seeds = (
        rows.select(*s.sliced).unionByName(replaced, allowMissingColumns=True)
        .groupBy(*s.sliced)
        .agg(*[F.expr(f"max(_at_{c}) as _at_{c}") for c in COMPONENTS])
        .selectExpr(*s.sliced, *[f"max(_at_{c}) {earlier} as _at_{c}" for c in COMPONENTS])
        .filter(" or ".join(f"_at_{c} is not null" for c in COMPONENTS))
    )
    # A failure speaks from the start of its warning span, in every slice the span touches.
    # The latest failure announced so far lies ahead exactly while a warning is due.
    warned = announce(failures, s, span).selectExpr(
        *s.sliced, f"_from as {ts}", *[f"case when failure = '{c}' then {ts} end as _fails_{c}" for c in COMPONENTS]
    )

    # At equal time events (kind 0) come before grid rows (kind 1); seeds have no time and come first.
    events = (
        seeds.unionByName(replaced, allowMissingColumns=True)
        .unionByName(warned, allowMissingColumns=True)
        .withColumn("_kind", F.lit(0))
    )
    tall = counted.unionByName(events, allowMissingColumns=True)
    so_far = f"over (partition by {by} order by {ts}, _kind rows between unbounded preceding and current row)"
    placed = tall.selectExpr(
        *s.sliced, ts, "_kind", "_copy",
        *[f"coalesce(sum({e}) {so_far}, 0L) as {e}" for e in ERRORS],
        *[f"max(_at_{c}) {so_far} as _last_{c}" for c in COMPONENTS],
        *[f"max(_fails_{c}) {so_far} as _next_{c}" for c in COMPONENTS],
    ).filter("_kind = 1")
    # Counts are whole numbers, so a rolling sum is the difference of two running sums.
    back = f"over (partition by {by} order by {ts})"
    matrix = placed.selectExpr(
        *keys, ts, "_copy",
        *[f"{e} - lag({e}, {rolling_rows}, 0L) {back} as {e}" for e in ERRORS],
        *[f"coalesce(timestampdiff(MICROSECOND, _last_{c}, {ts}) / 86400000000.0D, 0.0D) as {c}" for c in COMPONENTS],
        *[f"cast(coalesce(_next_{c} >= {ts}, false) as int) as risk_{c}" for c in COMPONENTS],
    ).filter("not _copy").drop("_copy")
    # No hint: Spark broadcasts the dimension only while its size stays under the threshold.
    return matrix.join(machines.select(*keys, "model", "age"), keys, "left")
