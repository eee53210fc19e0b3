"""Per-series window operators that never put one whole series into one task.

A series is cut into *slices*: fixed ranges of its order column. The big shuffle is on
``(keys, slice)``, so a machine holding a third of all rows is spread over as many tasks as
it has slices. What a slice needs from its neighbours travels separately and is small:

* bounded row frames (rolling statistics, look-ahead labels, sequences) get copies of the
  few border rows of neighbouring slices (``bounded``);
* unbounded frames (as-of, forward fill, running sums, ordinals) get one pre-aggregated
  value per slice, combined over the slices of a key (``carry``, ``running_sum``,
  ``ordinal``).

Results equal those of the plain window over the whole series for every slice width. Where no
fixed width fits, because values cluster anywhere, ``range_slices`` cuts by a sample instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

SLICE = "_slice"
DAY = 86_400


@dataclass(frozen=True)
class Series:
    """How rows form series: key columns, a total order, and the slice width.

    ``width`` is in seconds for a time column and in units of the column otherwise. Pick it
    so that the densest key has at most a few million rows per slice and far more rows than
    the longest row frame (see ``slice_width``). None means that the rows already carry their
    slices (see ``range_slices``).
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: float | None = 30 * DAY

    @property
    def sliced(self) -> list[str]:
        return [*self.keys, SLICE]

    def window(self, forward: bool = True) -> WindowSpec:
        order = self.order if forward else [F.col(c).desc() for c in self.order]
        return Window.partitionBy(*self.sliced).orderBy(*order)

    def over_slices(self, forward: bool = True) -> WindowSpec:
        """Window over the per-slice summary of a key (one row per slice, not per record)."""
        keys = [F.col(k) for k in self.keys] or [F.lit(0)]
        return Window.partitionBy(*keys).orderBy(SLICE if forward else F.col(SLICE).desc())


def position(df: DataFrame, column: str) -> Column:
    """The order column as a number: seconds since 1970 for times, the value itself otherwise."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    return F.col(column)


def with_slice(df: DataFrame, s: Series) -> DataFrame:
    if s.width is None:
        return df
    number = F.floor(position(df, s.order[0]) / F.lit(float(s.width))).cast("long")
    return df.withColumn(SLICE, F.coalesce(number, F.lit(-(2**62))))


def slice_width(df: DataFrame, s: Series, rows: int = 2_000_000, unit: int = 3600) -> float:
    """Measure a width that keeps the densest stretch of any key under ``rows`` per slice.

    One aggregation over the key and order columns; only one number reaches the driver. Run
    it when a table is set up and keep the number with the table.
    """
    probe = with_slice(df.select(*s.keys, s.order[0]), Series(s.keys, s.order, unit))
    densest = probe.groupBy(*s.sliced).count().agg(F.max("count")).first()[0] or 1
    return max(unit, unit * (rows // densest))


def range_slices(df: DataFrame, s: Series) -> tuple[DataFrame, Series]:
    """Rows cut into slices of about equal size whatever the distribution of keys and values.

    Range bounds come from a sample and may differ between runs, so the cut rows are written
    once. Use it on rows that are aggregated already, or where no width fits.
    """
    order = [*s.keys, *s.order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).withColumn(SLICE, F.spark_partition_id().cast("long"))
    return materialize(cut, "ranged"), replace(s, width=None)


def _border_rows(df: DataFrame, s: Series, n: int, forward: bool) -> DataFrame:
    """Copies of the ``n`` rows nearest to each slice on the far side of its border.

    ``forward`` copies the last rows of a slice into the slices after it, otherwise the
    first rows into the slices before it. Sparse slices pass the rows of their own
    neighbours on, so a frame may span any number of slices. The per-slice top-n is cut
    down before its shuffle.
    """
    towards = [F.col(c).desc() if forward else F.col(c).asc() for c in s.order]
    nearest = Window.partitionBy(*s.sliced).orderBy(*towards)
    edge = df.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= n)

    keys = [F.col(k) for k in s.keys] or [F.lit(0)]
    in_order = s.over_slices(forward)
    within_reach = Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, n - 1)
    # A slice of n rows or more ends every reach, so counts above n need not differ.
    reach = (
        df.groupBy(*s.sliced)
        .agg(F.least(F.count("*"), F.lit(n)).alias("_rows"))
        .withColumn("_end", F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_next", F.lead(SLICE).over(in_order))
        .withColumn(
            "_targets",
            F.collect_list(
                F.when(F.col("_next").isNotNull(), F.struct("_next", "_end"))
            ).over(within_reach),
        )
        .select(*s.sliced, F.col("_end").alias("_own_end"), "_targets")
    )
    return (
        edge.join(reach, s.sliced)
        .withColumn("_target", F.explode("_targets"))
        .filter(F.col("_target._end") - F.col("_own_end") + F.col("_rank") <= n)
        .withColumn(SLICE, F.col("_target._next"))
        .drop("_rank", "_own_end", "_targets", "_target")
    )


def bounded(
    df: DataFrame,
    s: Series,
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]],
    needs: Sequence[str] | None = None,
    keep: bool = False,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before``/``after`` rows.

    ``build`` receives the ordered window (without a frame); it may return several steps, each
    using the columns of the one before. ``needs`` names the columns its
    expressions read, so that border copies carry nothing else. ``keep`` leaves the slice
    column in place for a following step.
    """
    rows = with_slice(df, s)
    wanted = list(dict.fromkeys([*s.keys, SLICE, *s.order, *(df.columns if needs is None else needs)]))
    parts = rows.withColumn("_copy", F.lit(False))
    for n, forward in ((before, True), (after, False)):
        if n > 0:
            copies = _border_rows(rows.select(*wanted), s, n, forward)
            parts = parts.unionByName(
                copies.withColumn("_copy", F.lit(True)), allowMissingColumns=True
            )
    built = build(s.window())
    for columns in built if isinstance(built, list) else [built]:
        parts = parts.withColumns(columns)
    out = parts.filter(~F.col("_copy")).drop("_copy")
    return out if keep else out.drop(SLICE)


def carry(
    df: DataFrame, s: Series, values: dict[str, str], forward: bool = True, keep: bool = False
) -> DataFrame:
    """Last non-NULL value at or before each row (next at or after when not ``forward``).

    ``values`` maps output column to source column.
    """
    rows = with_slice(df, s)
    pick = F.max_by if forward else F.min_by
    at = F.struct(*s.order)
    # Rows without values only name their slice, which hashes cheaply; picking values sorts.
    known = " or ".join(f"`{c}` is not null" for c in values.values())
    picked = rows.filter(known).groupBy(*s.sliced).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_in_{o}") for o, c in values.items()]
    )
    summary = rows.groupBy(*s.sliced).agg(F.count("*").alias("_rows")).drop("_rows").join(picked, s.sliced, "left")
    # Backward carrying runs forward over the reversed order: frames that end at the last
    # row are evaluated anew for every row, frames that start at the first row are not.
    outer = s.over_slices(forward).rowsBetween(Window.unboundedPreceding, -1)
    inner = s.window(forward).rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumns(
        {f"_in_{o}": F.last(f"_in_{o}", ignorenulls=True).over(outer) for o in values}
    )
    out = rows.join(summary, s.sliced, "left")
    out = out.withColumns(
        {o: F.coalesce(F.last(c, ignorenulls=True).over(inner), F.col(f"_in_{o}")) for o, c in values.items()}
    ).drop(*[f"_in_{o}" for o in values])
    return out if keep else out.drop(SLICE)


def running_sum(df: DataFrame, s: Series, values: dict[str, str]) -> DataFrame:
    """Inclusive prefix sums per series; ``values`` maps output column to source column."""
    rows = with_slice(df, s)
    outer = s.over_slices().rowsBetween(Window.unboundedPreceding, -1)
    inner = s.window().rowsBetween(Window.unboundedPreceding, 0)
    summary = (
        rows.groupBy(*s.sliced)
        .agg(*[F.sum(c).alias(f"_in_{o}") for o, c in values.items()])
        .withColumns({f"_in_{o}": F.sum(f"_in_{o}").over(outer) for o in values})
    )
    out = rows.join(summary, s.sliced, "left").withColumns(
        {
            o: F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.coalesce(F.col(f"_in_{o}"), F.lit(0))
            for o, c in values.items()
        }
    )
    return out.drop(SLICE, *[f"_in_{o}" for o in values])


def ordinal(df: DataFrame, s: Series, out: str = "ordinal", total: str | None = None) -> DataFrame:
    """0-based position of each row within its series, and optionally the series length."""
    rows = with_slice(df, s)
    outer = s.over_slices()
    keys = [F.col(k) for k in s.keys] or [F.lit(0)]
    summary = rows.groupBy(*s.sliced).agg(F.count("*").alias("_rows"))
    columns = {"_before": F.coalesce(F.sum("_rows").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    if total:
        columns[total] = F.sum("_rows").over(Window.partitionBy(*keys))
    summary = summary.withColumns(columns).drop("_rows")
    return (
        rows.join(summary, s.sliced)
        .withColumn(out, F.col("_before") + F.row_number().over(s.window()) - 1)
        .drop(SLICE, "_before")
    )
