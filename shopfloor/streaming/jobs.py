"""Streaming jobs: windows, alert state, upserts, histories.

The caller names a folder per job. It holds the job's progress, state and output, so a job that was stopped, or that runs
on a schedule, goes on where it was; every start returns the ``StreamingQuery``. Jobs run over what has arrived and stop,
unless another trigger is given.

Window and alert jobs keep the rows still open and the last few rows of every machine between micro-batches and run the
batch operators over kept and new rows together. A machine that sends a third of a batch is therefore cut into slices
exactly as in batch, which state kept in one task per key could not offer. Tables are numbered by batch: a batch that is
run again reads the same kept rows and overwrites its own output. The last two versions of the state are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scaling import apply_scaler
from ..operators.series import Series
from ..operators.windows import latest_per_key, sequences

AVAILABLE = {"availableNow": True}


def start(writer, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a job whose progress lies in ``folder``; with the default trigger, wait until all that has arrived is done."""
    run = writer.option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or AVAILABLE)).start()
    if trigger is None:
        run.awaitTermination()
    return run


def drop_version(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append_to_table(stream: DataFrame, path: str, partition: Sequence[str] = ()):
    """Append writer for a growing history table."""
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    return writer.partitionBy(*partition) if partition else writer


def stream_to_table(stream: DataFrame, folder: str, partition: Sequence[str] = (), trigger: dict | None = None) -> StreamingQuery:
    """Append the stream to the table in ``folder/rows``."""
    return start(append_to_table(stream, f"{folder}/rows", partition), folder, trigger)


def table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows a job has put out so far."""
    if not exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.names)


def _newest(spark: SparkSession, folder: str) -> int | None:
    """The last batch whose marks are written, which happens after everything else of a batch."""
    return spark.read.parquet(f"{folder}/marks").agg(F.max("batch")).first()[0] if exists(spark, f"{folder}/marks") else None


def _state(spark: SparkSession, folder: str, batch: int | None, schema) -> DataFrame:
    if batch is None or batch < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/state/batch={batch}")


def _retire(spark: SparkSession, folder: str, batch: int) -> None:
    for part in ("state", "marks"):
        if batch >= 2:
            drop_version(spark, f"{folder}/{part}/batch={batch - 2}")


@dataclass(frozen=True)
class TailJob:
    """A bounded-frame operator over a stream.

    ``compute`` sees the open rows and, of every series, the ``tail`` rows before them; ``_new`` marks the rows wanted and
    must be passed through. Rows stay open for ``delay`` behind the newest time seen, and a late row within it takes its
    place in the order; then they are put out for good. Later rows are dropped and counted. ``result`` adds the rows still
    open, as they look now.
    """

    folder: str
    schema: object
    series: Series
    tail: int
    compute: Callable[[DataFrame], DataFrame]
    delay: str = "1 day"

    def _kept(self):
        from pyspark.sql.types import BooleanType, StructField, StructType

        return StructType([*self.schema.fields, StructField("_due", BooleanType())])

    def start(self, stream: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return start(stream.writeStream.foreachBatch(self.step), self.folder, trigger)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        spark, s, ts = batch.sparkSession, self.series, self.series.order[0]
        batch = batch.persist()
        try:
            before = spark.read.parquet(f"{self.folder}/marks/batch={batch_id - 1}").first() if batch_id else None
            closed = F.lit(before["closed"] if before else None)
            fresh = batch.filter(F.coalesce(F.col(ts) >= closed, F.lit(True)))
            mark = batch.agg(
                F.greatest(F.lit(before["high"] if before else None), F.max(ts)).alias("high"),
                (F.count_if(F.col(ts) < closed) + (before["late"] if before else 0)).alias("late"),
            ).select("high", (F.col("high") - F.expr(f"INTERVAL {self.delay}")).alias("closed"), "late").first()
            open_from = F.lit(mark["closed"]).cast(batch.schema[ts].dataType)
            rows = fresh.withColumn("_due", F.lit(True)).unionByName(_state(spark, self.folder, batch_id - 1, self._kept()))
            done = F.coalesce(F.col(ts) < open_from, F.lit(False))
            result = self.compute(rows.withColumn("_new", F.col("_due") & done).drop("_due")).filter("_new").drop("_new")
            result.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")
            # Each task keeps its newest rows per series before the shuffle.
            newest = Window.partitionBy(*s.keys).orderBy(*[F.col(c).desc() for c in s.order])
            last = rows.filter(done).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= self.tail).drop("_r")
            kept = last.withColumn("_due", F.lit(False)).unionByName(rows.filter(~done))
            kept.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}")
            marks = spark.createDataFrame([tuple(mark)], f"high {batch.schema[ts].dataType.simpleString()}, closed {batch.schema[ts].dataType.simpleString()}, late long")
            marks.write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch_id}")
        finally:
            batch.unpersist()
        _retire(spark, self.folder, batch_id)

    def result(self, spark: SparkSession) -> DataFrame:
        newest = _newest(spark, self.folder)
        kept = _state(spark, self.folder, newest, self._kept())
        provisional = self.compute(kept.withColumnRenamed("_due", "_new")).filter("_new").drop("_new")
        if newest is None:
            return provisional
        final = spark.read.schema(provisional.schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/rows")
        return final.unionByName(provisional)

    def late(self, spark: SparkSession) -> int:
        """Rows dropped because they came more than ``delay`` behind."""
        newest = _newest(spark, self.folder)
        return 0 if newest is None else spark.read.parquet(f"{self.folder}/marks/batch={newest}").first()["late"]


def live_windows(
    schema, s: Series, cols: Sequence[str], folder: str, keep: Sequence[str] = (), n: int = 24, delay: str = "1 day",
    min_rows: int | None = None, scaler: DataFrame | None = None,
) -> TailJob:
    """Window of the last ``n`` rows at every tick of a stream, scaled by the one row of ``scaler``, from ``min_rows`` rows on."""

    def compute(rows: DataFrame) -> DataFrame:
        scaled = rows if scaler is None else apply_scaler(rows, scaler, cols)
        return sequences(scaled, s, cols, n, keep=[*keep, "_new"], min_rows=min_rows)

    return TailJob(folder, schema, s, n - 1, compute, delay)


def alert_states(schema, s: Series, folder: str, risk: str = "risk", delay: str = "1 day") -> TailJob:
    """Trend, level and shown risk of every tick of a stream."""
    from ..plans.live import alert_history

    return TailJob(folder, schema, s, 2, lambda rows: alert_history(rows, s, risk), delay)


def enrich(stream: DataFrame, machines: DataFrame, erp: DataFrame | None, keys: Sequence[str] = ("machine_id",), ts: str = "datetime") -> DataFrame:
    """Stream rows with machine attributes, and with the exact state of their time if given."""
    out = stream.join(machines, list(keys), "left")
    return out if erp is None else out.join(erp, [*keys, ts], "left")


def enrich_live(
    stream: DataFrame, states: DataFrame, machines: DataFrame, keys: Sequence[str] = ("machine_id",), ts: str = "ts", at: str = "datetime",
    delay: str = "1 hour",
) -> DataFrame:
    """Stream rows with the state of their machine-hour from a second stream, and with machine attributes.

    Both sides meet on (machine, hour), so a machine that sends a third of all rows is spread over its hours, and both forget
    an hour once the watermark, ``delay`` behind the slower side, has passed it. A row comes out as soon as its state is there,
    whichever side arrives first; a row whose hour passes without a state comes out then, its state NULL.
    """
    left = stream.withColumn("_hour", F.date_trunc("hour", ts)).withWatermark("_hour", delay)
    right = states.withColumn("_hour", F.date_trunc("hour", at)).drop(at).withWatermark("_hour", delay)
    return left.join(right, [*keys, "_hour"], "left_outer").join(machines, list(keys), "left").drop("_hour")


def upsert_latest(stream: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Latest row per key, refreshed by every micro-batch into a new numbered table; ``latest`` reads it."""
    schema = stream.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = _state(spark, folder, batch_id - 1, schema)
        newest = latest_per_key(old.unionByName(batch), keys, order)
        newest.select(*schema.names).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")
        _retire(spark, folder, batch_id)

    return start(stream.writeStream.foreachBatch(step), folder, trigger)


def latest(spark: SparkSession, folder: str, schema) -> DataFrame:
    return _state(spark, folder, _newest(spark, folder), schema)


def write_predictions(stream: DataFrame, folder: str, ts: str = "time", trigger: dict | None = None) -> StreamingQuery:
    """Append predictions with their reasons to a history partitioned by date."""
    return stream_to_table(stream.withColumn("event_date", F.to_date(ts)), folder, ["event_date"], trigger)
