"""Column profiles, reports, correlations and label audits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import TARGET_PARTS
from .series import Series, bounded, range_slices, running_sum

# Report texts.
STATUS_UNREADABLE = "Lỗi đọc dữ liệu"
STATUS_EMPTY = "Bảng không có dữ liệu"
STATUS_ALL_NULL = "Cột toàn NULL"
STATUS_HAS_NULL = "Cột có NULL"
STATUS_COMPLETE = "Cột đầy đủ dữ liệu"
UNSUPPORTED = "[Không hỗ trợ kdl này]"
NOT_AVAILABLE = "N/A"


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _is_opaque(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def _columns_to_rows(row: DataFrame, columns: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Turn a one-row frame with ``<i>_<field>`` columns into one row per source column."""
    structs = [
        F.struct(F.lit(name).alias("column"), *[_ref(f"{i}_{f}").cast(t).alias(f) for f, t in fields.items()])
        for i, name in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*structs)))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, distinct count (NULL excluded), missing count and percentage per column.

    ``exact=False`` uses sketches and needs one pass without the expansion of exact
    distinct counts; prefer it for tables of many wide rows.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    names = df.columns
    stats = []
    for i, name in enumerate(names):
        stats += [distinct(_ref(name)).alias(f"{i}_unique"), F.count_if(_ref(name).isNull()).alias(f"{i}_missing")]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *stats)
    kinds = [F.lit(df.schema[n].dataType.simpleString()).alias(f"{i}_type") for i, n in enumerate(names)]
    share = [
        F.coalesce(_ref(f"{i}_missing") / _ref("_rows") * 100, F.lit(0.0)).alias(f"{i}_missing_pct") for i in range(len(names))
    ]
    return _columns_to_rows(
        row.select("*", *kinds, *share), names,
        {"type": "string", "unique": "long", "missing": "long", "missing_pct": "double"},
    )


def describe_numeric(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of every numeric column, in one pass."""
    names = [f.name for f in df.schema if _is_number(f.dataType)]
    stats = []
    for i, name in enumerate(names):
        stats += [
            F.avg(_ref(name)).alias(f"{i}_mean"), F.stddev_samp(_ref(name)).alias(f"{i}_std"),
            F.min(_ref(name)).cast("double").alias(f"{i}_min"), F.max(_ref(name)).cast("double").alias(f"{i}_max"),
        ]
    return _columns_to_rows(df.agg(*stats), names, dict.fromkeys(("mean", "std", "min", "max"), "double"))


def corrected_skewness(value: Column) -> Column:
    """Skewness with the small-sample correction, NULL below three values."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def audit_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """Counts and rounded statistics of numeric columns, sample values of the others."""
    names = df.columns
    stats = []
    for i, name in enumerate(names):
        c = _ref(name)
        stats += [F.count_if(c.isNull()).alias(f"{i}_missing"), F.count_distinct(c).alias(f"{i}_unique")]
        if _is_number(df.schema[name].dataType):
            number = c.cast("double")
            stats += [
                F.round(agg, digits).alias(f"{i}_{stat}")
                for stat, agg in (
                    ("min", F.min(number)), ("max", F.max(number)), ("mean", F.avg(number)),
                    ("std", F.stddev_samp(number)), ("skew", corrected_skewness(number)),
                )
            ]
    row = df.agg(*stats)
    numeric = [n for n in names if _is_number(df.schema[n].dataType)]
    fill = [
        F.lit(None).cast("double").alias(f"{i}_{stat}")
        for i, n in enumerate(names) if n not in numeric for stat in ("min", "max", "mean", "std", "skew")
    ]
    # A constant column has skewness 0.
    constant = {
        f"{i}_skew": F.when(_ref(f"{i}_unique") > 1, _ref(f"{i}_skew")).otherwise(0.0)
        for i, n in enumerate(names) if n in numeric
    }
    rows = _columns_to_rows(
        row.select("*", *fill).withColumns(constant), names,
        {"missing": "long", "unique": "long", **dict.fromkeys(("min", "max", "mean", "std", "skew"), "double")},
    )
    texts = [n for n in names if n not in numeric]
    if not texts:
        return rows.withColumn("samples", F.lit(None).cast("string"))
    return rows.join(sample_values(df, texts), "column", "left")


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per (column, value as text), NULL dropped."""
    pairs = [F.struct(F.lit(c).alias("column"), _ref(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())


def sample_values(df: DataFrame, cols: Sequence[str], n: int = 3) -> DataFrame:
    """Up to ``n`` distinct values per column, the smallest as text, joined by comma.

    The k-th smallest is the minimum above the one before it: ``n`` small aggregations over
    all columns at once instead of a shuffle of every distinct value.
    """
    row = df.agg(*[F.min(_ref(c)).alias(f"{i}_v") for i, c in enumerate(cols)])
    found = [row.select(F.struct("*")).scalar()]
    for _ in range(n - 1):
        # Held in one column, so that each level of the plan names the level below once.
        above = df.withColumn("_s", found[-1])
        row = above.agg(
            *[F.min(F.when(_ref(c) > F.col("_s")[f"{i}_v"], _ref(c))).alias(f"{i}_v") for i, c in enumerate(cols)]
        )
        found.append(row.select(F.struct("*")).scalar())
    held = df.sparkSession.range(1).select(*[v.alias(f"_s{k}") for k, v in enumerate(found)])
    texts = [
        F.struct(
            F.lit(c).alias("column"),
            F.concat_ws(", ", *[F.col(f"_s{k}")[f"{i}_v"].cast("string") for k in range(n)]).alias("samples"),
        )
        for i, c in enumerate(cols)
    ]
    return held.select(F.inline(F.array(*texts))).withColumn("samples", F.nullif("samples", F.lit("")))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count of every value per column, NULL excluded; counted in each task first."""
    return _long(df, cols).groupBy("column", "value").agg(F.count("*").alias("n"))


def label_candidates(df: DataFrame, below: int = 15, parts: Sequence[str] = TARGET_PARTS) -> DataFrame:
    """Columns that look like labels: few distinct values, or a telling name."""
    named = F.lit(False)
    for part in parts:
        named = named | F.lower("column").contains(part)
    few = (F.col("unique") > 1) & (F.col("unique") < below)
    out = profile(df).select("column", "unique", few.alias("few_values"), named.alias("telling_name"))
    return out.filter("few_values or telling_name")


def top_correlations(df: DataFrame, target: str, k: int = 8) -> DataFrame:
    """The ``k`` numeric columns with the largest absolute correlation with ``target``."""
    names = [f.name for f in df.schema if _is_number(f.dataType)]
    row = df.agg(*[F.abs(F.corr(_ref(target), _ref(n))).alias(f"{i}_correlation") for i, n in enumerate(names)])
    rows = _columns_to_rows(row, names, {"correlation": "double"}).filter(F.col("correlation").isNotNull())
    return rows.orderBy(F.desc("correlation"), "column").limit(k)


def exact_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median per key from value counts; equal values meet before any ordering."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts, cut = range_slices(counts, Series(tuple(keys), (value,)))
    total = F.sum("_n").alias("_total")
    reached = running_sum(counts, cut, {"_upto": "_n"})
    if keys:
        placed = reached.join(counts.groupBy(*keys).agg(total), list(keys))
    else:
        placed = reached.withColumn("_total", counts.agg(total).scalar())
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
    middle = placed.filter(holds(low) | holds(high))
    result = F.max(value), F.min(value)
    agg = ((result[0] + result[1]) / 2).alias("median")
    return middle.groupBy(*keys).agg(agg) if keys else middle.agg(agg)


def time_coverage(df: DataFrame, s: Series) -> DataFrame:
    """First and last time and the median gap between rows, per series."""
    ts = s.order[0]
    gap = bounded(
        df.select(*s.keys, *s.order), s, 1, 0,
        lambda w: {"_gap": F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) / F.lit(1e6)}, needs=[],
    )
    span = df.groupBy(*s.keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    median = exact_median(gap, s.keys, "_gap").withColumnRenamed("median", "median_gap_seconds")
    return span.join(median, list(s.keys), "left")


def column_report(tables: Mapping[str, DataFrame | Callable[[], DataFrame]], samples: int = 3) -> DataFrame:
    """Row counts, ranges, samples and status of every column of every table.

    One aggregation per table. Tables may be given as functions that open them; one that
    cannot be opened is reported, not raised.
    """
    report = None
    for name, table in tables.items():
        try:
            part = _table_report(name, table() if callable(table) else table, samples)
        except AnalysisException as problem:
            part = unreadable_report(SparkSession.active(), name, str(problem))
        report = part if report is None else report.unionByName(part, allowMissingColumns=True)
    status = (
        F.when(F.col("rows").isNull(), STATUS_UNREADABLE)
        .when(F.col("rows") == 0, STATUS_EMPTY)
        .when(F.col("non_null") == 0, STATUS_ALL_NULL)
        .when(F.col("non_null") < F.col("rows"), STATUS_HAS_NULL)
        .otherwise(STATUS_COMPLETE)
    )
    shown = {c: F.coalesce(c, F.lit(NOT_AVAILABLE)) for c in ("min_value", "max_value", "sample_values")}
    return report.withColumn("status", status).withColumns(shown)


def _table_report(name: str, df: DataFrame, samples: int) -> DataFrame:
    cols = df.columns
    plain = [c for c in cols if not _is_opaque(df.schema[c].dataType)]
    stats = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        stats.append(F.count(_ref(c)).alias(f"{i}_non_null"))
        for side, agg in (("min", F.min), ("max", F.max)):
            # Adding zero makes one of both zeros, of which either may be met first.
            zero = F.lit(0).cast(df.schema[c].dataType) if df.schema[c].dataType.typeName() in ("double", "float") else None
            value = agg(_ref(c) if zero is None else _ref(c) + zero).cast("string") if c in plain else F.lit(UNSUPPORTED)
            stats.append(value.alias(f"{i}_{side}_value"))
    rows = [F.col("_rows").alias(f"{i}_rows") for i in range(len(cols))]
    kinds = [F.lit(df.schema[c].dataType.simpleString()).alias(f"{i}_type") for i, c in enumerate(cols)]
    out = _columns_to_rows(
        df.agg(*stats).select("*", *rows, *kinds), cols,
        {"type": "string", "rows": "long", "non_null": "long", "min_value": "string", "max_value": "string"},
    )
    if plain:
        out = out.join(sample_values(df, plain, samples).withColumnRenamed("samples", "sample_values"), "column", "left")
    else:
        out = out.withColumn("sample_values", F.lit(None).cast("string"))
    opaque = ~F.col("column").isin(plain) if plain else F.lit(True)
    return out.withColumn("sample_values", F.when(opaque, UNSUPPORTED).otherwise(F.col("sample_values"))).select(
        F.lit(name).alias("table"), "*"
    )


def unreadable_report(spark, table: str, problem: str) -> DataFrame:
    """Report row of a table that could not be opened."""
    return spark.createDataFrame(
        [(table, NOT_AVAILABLE, NOT_AVAILABLE, None, None, None, None, f"{STATUS_UNREADABLE}: {problem[:100]}")],
        """table string, column string, type string, rows long, non_null long, min_value string, max_value string,
        sample_values string""",
    )


def column_count(spark, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of columns per table, from schemas alone."""
    return spark.createDataFrame([(t, len(df.columns)) for t, df in tables.items()], "table string, columns int")


def label_audit(df: DataFrame, target: str) -> DataFrame:
    """Label balance and the model strategy it calls for."""
    out = df.filter(F.col(target).isNotNull()).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.col(target).cast("long")), F.lit(0)).alias("failures")
    )
    rate = F.col("failures") / F.col("rows")
    return out.select(
        "rows", (F.col("rows") - F.col("failures")).alias("healthy"), "failures", rate.alias("rate"),
        (F.col("rows") >= 3000).alias("deep_model_allowed"),
        F.when(F.col("rows") == 0, "no_labels").when(rate < 0.05, "anomaly_detection")
        .when(rate > 0.85, "reweight_or_undersample").otherwise("supervised").alias("strategy"),
    )


def reliability(df: DataFrame, s: Series, target: str, minutes: int) -> DataFrame:
    """Failure events, repair and run times in hours, and a risk window, per series.

    The window is 15 % of the time between failures within [4 steps, 24 h]; for records
    under 50 hours 5 % of the record, at most 2 h. Rounded down to whole steps, at least one.
    """
    onset = bounded(
        df.select(*s.keys, *s.order, target), s, 1, 0,
        lambda w: {"_on": (F.col(target) - F.lag(target).over(w) == 1).cast("int")}, needs=[target],
    )
    hours = lambda rows: rows * minutes / 60.0
    out = onset.groupBy(*s.keys).agg(
        F.count("*").alias("rows"), F.sum(F.col(target).cast("long")).alias("failing_rows"),
        F.coalesce(F.sum("_on"), F.lit(0)).cast("long").alias("_events"),
    ).filter("failing_rows > 0")
    events = F.greatest(F.col("_events"), F.lit(1))
    out = out.withColumn("failure_events", events).withColumns({
        "total_hours": hours(F.col("rows")),
        "mttr_hours": hours(F.col("failing_rows")) / events,
        "mtbf_hours": hours(F.col("rows") - F.col("failing_rows")) / events,
    })
    long_record = F.greatest(F.lit(minutes * 4 / 60.0), F.least(F.col("mtbf_hours") * 0.15, F.lit(24.0)))
    short_record = F.least(F.lit(2.0), F.col("total_hours") * 0.05)
    window = F.when(F.col("total_hours") < 50, short_record).otherwise(long_record)
    steps = F.greatest(F.lit(1), (window * 60 / minutes).cast("int"))
    return out.withColumn("window_steps", steps).withColumn("window_hours", hours(F.col("window_steps"))).drop("_events")
