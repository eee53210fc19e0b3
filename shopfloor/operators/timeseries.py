"""Rolling, carrying and positional operators on time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import stable_hash
from ..session import materialize
from .series import SLICE, Series, bounded, carry, ordinal, position, with_slice


def rolling_sum(df: DataFrame, s: Series, cols: Sequence[str], n: int = 24, suffix: str = "") -> DataFrame:
    """Sum of the last ``n`` rows including the current one; shorter at the start of a series.

    Whole numbers take the difference of two running sums, one step per row; fractions are
    summed anew over each frame, which adds no rounding error.
    """
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in cols)

    def build(w):
        if not whole:
            return {f"{c}{suffix}": F.sum(c).over(w.rowsBetween(-(n - 1), 0)) for c in cols}
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        running = {f"_c_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in cols}
        known = {f"_k_{c}": F.count(c).over(w.rowsBetween(-(n - 1), 0)) for c in cols}
        # Only NULL in the whole frame gives NULL.
        total = {
            f"{c}{suffix}": F.when(F.col(f"_k_{c}") > 0, F.col(f"_c_{c}") - F.lag(f"_c_{c}", n, 0).over(w)) for c in cols
        }
        return [running | known, total]

    out = bounded(df, s, n - 1, 0, build, needs=cols)
    return out.drop(*[f"{p}{c}" for c in cols for p in ("_c_", "_k_")])


def rolling_std(
    df: DataFrame, s: Series, cols: Sequence[str], n: int = 6, min_rows: int = 3, suffix: str = "_roll_std_6"
) -> DataFrame:
    """Sample deviation of the last ``n`` rows, 0 with fewer than ``min_rows`` non-NULL values."""

    def build(w):
        frame = w.rowsBetween(-(n - 1), 0)
        return {
            f"{c}{suffix}": F.when(F.count(c).over(frame) >= min_rows, F.stddev_samp(c).over(frame)).otherwise(0.0)
            for c in cols
        }

    return bounded(df, s, n - 1, 0, build, needs=cols)


def rolling_sum_hours(df: DataFrame, s: Series, cols: Sequence[str], hours: int, suffix: str = "") -> DataFrame:
    """Sum over the last ``hours`` hours by clock time to the microsecond, for irregular grids.

    The frame is a time range, so each row is copied into every slice its value can reach.
    """
    span = hours * 3600 * 1_000_000
    when = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{s.order[0]}`)")
    rows = with_slice(df, s)
    reach = F.floor((when + span - 1) / F.lit(s.width * 1e6)).cast("long")
    copies = (
        rows.select(*s.sliced, *s.order, *cols)
        .withColumn("_to", reach)
        .filter(F.col("_to") > F.col(SLICE))
        .withColumn(SLICE, F.explode(F.sequence(F.col(SLICE) + 1, F.col("_to"))))
        .drop("_to")
    )
    parts = rows.withColumn("_copy", F.lit(False)).unionByName(
        copies.withColumn("_copy", F.lit(True)), allowMissingColumns=True
    )
    frame = Window.partitionBy(*s.sliced).orderBy(when).rangeBetween(-(span - 1), 0)
    out = parts.withColumns({f"{c}{suffix}": F.sum(c).over(frame) for c in cols})
    return out.filter(~F.col("_copy")).drop("_copy", SLICE)


def forward_fill(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Replace NULL by the last value before it in the series."""
    filled = carry(df, s, {f"_f_{c}": c for c in cols})
    return filled.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def lookahead_max(df: DataFrame, s: Series, target: str, rows: int, out: str = "risk_ahead", tail: str = "zero") -> DataFrame:
    """Maximum of ``target`` over the next ``rows`` rows, the current one excluded.

    Rows with fewer than ``rows`` successors get 0, or NULL with ``tail='null'``. A series is cut into blocks of ``rows``
    positions. What lies ahead of position r of a block is the rest of the block and the next block up to its position r:
    one running maximum from the back and one from the front. Each value is copied once, into the block before its own,
    and a task holds two blocks at a time, whatever the length and however rows spread over slices.
    """
    otherwise = F.lit(0) if tail == "zero" else F.lit(None)
    number = F.floor(F.col("_at") / rows)
    twice = F.when(number > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = ordinal(df, s, "_at").withColumn("_next", F.explode(twice))
    # A copy carries its value and its place only.
    both = both.select(
        *[c if c in s.keys else F.when(~F.col("_next"), F.col(c)).alias(c) for c in df.columns],
        "_next", F.col(target).alias("_v"), (number - F.col("_next").cast("int")).alias("_block"), (F.col("_at") % rows).alias("_at"),
    )
    block = Window.partitionBy(*s.keys, "_block")
    # At equal positions the next block's row comes before the row it belongs to, in both directions.
    upto = block.orderBy(F.asc("_at"), F.desc("_next")).rowsBetween(Window.unboundedPreceding, 0)
    onward = block.orderBy(F.desc("_at"), F.desc("_next")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns({
        "_upto": F.max(F.when(F.col("_next"), F.col("_v"))).over(upto),
        "_reach": F.max(F.when(F.col("_next"), F.col("_at"))).over(upto),
        "_onward": F.max(F.when(~F.col("_next"), F.col("_v"))).over(onward),
    }).filter(~F.col("_next"))
    label = F.when(F.col("_reach") == F.col("_at"), F.coalesce(F.greatest("_upto", "_onward"), otherwise)).otherwise(otherwise)
    return seen.withColumn(out, label).drop("_at", "_block", "_next", "_v", "_upto", "_reach", "_onward", SLICE)


def has_history(df: DataFrame, s: Series, n: int = 24, out: str = "has_history") -> DataFrame:
    """Whether the row ``n - 1`` places earlier belongs to the same series."""
    return bounded(
        df, s, n - 1, 0, lambda w: {out: F.lag(F.lit(True), n - 1).over(w).isNotNull()}, needs=[]
    )


def transitions(df: DataFrame, s: Series, target: str) -> DataFrame:
    """First difference (0 at the start) and a flag where ``target`` goes from 0 to 1."""

    def build(w):
        diff = F.coalesce(F.col(target) - F.lag(target).over(w), F.lit(0))
        return {"diff": diff, "is_onset": (diff == 1).cast("int")}

    return bounded(df, s, 1, 0, build, needs=[target])


def gaps(df: DataFrame, s: Series, out: str = "gap_seconds") -> DataFrame:
    """Seconds since the previous row of the series."""
    ts = s.order[0]
    return bounded(
        df, s, 1, 0,
        lambda w: {out: F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts))},
        needs=[],
    )


def interpolate(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Linear interpolation by row position.

    NULLs before the first value stay, NULLs after the last value repeat it. Every slice is summed up once, by its rows and
    its first and last known value with their positions; what a slice needs from either side comes from that one table.
    """
    numbered = with_slice(df, s).withColumn("_at", F.row_number().over(s.window()))
    marked = numbered.withColumns(
        {f"_p_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.col("_at").cast("long").alias("i"))) for c in cols}
    )
    picks = [f(f"_p_{c}", F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"{p}{c}") for c in cols for f, p in ((F.max_by, "_a_"), (F.min_by, "_b_"))]
    summary = marked.groupBy(*s.sliced).agg(F.count("*").alias("_rows"), *picks)
    before = lambda forward: s.over_slices(forward).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_start", F.coalesce(F.sum("_rows").over(before(True)), F.lit(0)))

    def moved(c: str) -> Column:
        """The mark with its position in the whole series instead of the slice."""
        return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.v").alias("v"), (F.col(f"{c}.i") + F.col("_start")).alias("i")))

    summary = summary.withColumns({f"{p}{c}": moved(f"{p}{c}") for c in cols for p in ("_a_", "_b_")})
    summary = summary.select(*s.sliced, "_start", *[
        F.last(f"{p}{c}", ignorenulls=True).over(before(forward)).alias(f"{p}{c}") for c in cols for p, forward in (("_a_", True), ("_b_", False))
    ])
    both = marked.join(summary, s.sliced, "left")
    both = both.withColumn("_at", F.col("_at") + F.col("_start")).withColumns({f"_p_{c}": moved(f"_p_{c}") for c in cols})
    near = lambda c, forward: F.last(f"_p_{c}", ignorenulls=True).over(s.window(forward).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({f"{p}{c}": F.coalesce(near(c, forward), F.col(f"{p}{c}")) for c in cols for p, forward in (("_a_", True), ("_b_", False))})

    def value(c: str) -> Column:
        left, right = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        share = (F.col("_at") - left["i"]) / (right["i"] - left["i"])
        line = left["v"] + (right["v"] - left["v"]) * share
        return F.when(F.col(c).isNotNull(), F.col(c)).when(right.isNull(), left["v"]).otherwise(line)

    out = both.withColumns({c: value(c) for c in cols})
    return out.drop(SLICE, "_at", "_start", *[f"{p}{c}" for c in cols for p in ("_p_", "_a_", "_b_")])


def ordered_index(df: DataFrame, order: Sequence[str], out: str = "row_index", partitions: int | None = None) -> DataFrame:
    """0-based position in the global order of ``order``, without a single-task sort.

    Range partitioning spreads even one hot value as long as ``order`` ends in distinguishing
    columns. The ranged rows are written once: range bounds come from a sample, so counting
    and numbering must see the same layout. Only one count per partition is broadcast.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    kept = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        kept.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + within)
        .drop("_id", "_part", "_offset")
    )


def synthetic_sequence(df: DataFrame, by: Sequence[str], block: int = 1_000_000) -> tuple[DataFrame, Series]:
    """Treat independent samples ordered by wear as one series; returns rows and their series."""
    return ordered_index(df, by, "row_index"), Series((), ("row_index",), block)


def usage_counter(df: DataFrame, order: Sequence[str], mod: int = 5000, out: str = "tool_hits_count") -> DataFrame:
    """Row position in the global order modulo ``mod``."""
    return ordered_index(df, order, "_i").withColumn(out, F.col("_i") % mod).drop("_i")


def days_since_reset(
    index: Column, start: float = 5.2, step: float = 1 / 1440, resets: Sequence[int] = (400, 1200)
) -> Column:
    """Counter growing by ``step`` per row before it is read, 0 at each reset row.

    A closed form of the row index, so it needs no window.
    """
    last = F.greatest(F.lit(-1), *[F.when(index >= r, F.lit(r)).otherwise(-1) for r in resets])
    return F.when(last < 0, start + (index + 1) * step).otherwise((index - last) * step)


def assign_timestamps(index: Column, start: str, minutes: int) -> Column:
    """``start`` plus ``index`` steps of ``minutes``."""
    return F.lit(start).cast("timestamp_ntz") + F.expr(f"INTERVAL '{minutes}' MINUTE") * index


def progress(df: DataFrame, s: Series, out: str = "progress") -> DataFrame:
    """Row position over last position, 0 for a series of one row."""
    numbered = ordinal(df, s, "_i", "_n")
    return numbered.withColumn(out, F.col("_i") / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_i", "_n")


def slice_by_ordinal(df: DataFrame, s: Series, n: int = 51, seed: int = 0) -> DataFrame:
    """``n`` consecutive rows per series, from a start chosen by key and seed; shorter series drop out."""
    numbered = ordinal(df, s, "_i", "_n")
    first = F.pmod(stable_hash(*s.keys, seed=seed), F.col("_n") - (n - 1))
    return (
        numbered.filter(F.col("_n") >= n)
        .withColumn("step", F.col("_i") - first)
        .filter((F.col("step") >= 0) & (F.col("step") < n))
        .drop("_i", "_n")
    )


def last_event(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of the latest event per key."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in cols])


def risk_trend(df: DataFrame, s: Series, risk: str, out: str = "trend") -> DataFrame:
    """Half the rise over the last three rows; 0 until three rows exist."""
    return bounded(
        df, s, 2, 0,
        lambda w: {out: F.coalesce((F.col(risk) - F.lag(risk, 2).over(w)) / 2, F.lit(0.0))},
        needs=[risk],
    )
