"""Alert state and live windows kept by Spark's state store: one short history per machine.

For feeds whose micro-batches are small, such as one row per machine and tick. Feeds with
hot machines or backfills use ``jobs.alert_states`` and ``jobs.live_windows``, which split machines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..constants import TREND_ROWS
from ..operators import alerts as A

OUTPUT = "machine_id long, ts timestamp, event_id long, risk double, trend double"


STATE = "risks array<double>"


def advance(days_to_live: int | None):
    """The update of one machine: its last risks go before the batch's, and three shifts give every trend."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        past = list(state.get[0]) if state.exists else []
        risks = pd.Series([*past, *batch["risk"].astype(float)])
        trend = ((risks - risks.shift(TREND_ROWS - 1)) / 2).fillna(0.0)
        state.update((risks.tail(TREND_ROWS - 1).tolist(),))
        if days_to_live is not None:
            newest = int(batch["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + days_to_live * 86_400_000)
        out = batch[["ts", "event_id", "risk"]].assign(machine_id=key[0], trend=trend.iloc[len(past) :].to_numpy())
        yield out[["machine_id", "ts", "event_id", "risk", "trend"]]

    return step


def alert_state(stream: DataFrame, delay: str = "7 days", days_to_live: int | None = None) -> DataFrame:
    """Stateful stream of ``(machine_id, ts, event_id, risk)`` rows with event time ``ts``.

    Levels and shown risks are the batch expressions over the trend. With ``days_to_live`` the history of a machine silent
    for so long is dropped and its next trend starts anew; by default histories stay. Expiry follows event time: a
    processing-time timeout keeps an ``availableNow`` run alive.
    """
    timeout = GroupStateTimeout.NoTimeout if days_to_live is None else GroupStateTimeout.EventTimeTimeout
    trends = stream.withWatermark("ts", delay).groupBy("machine_id").applyInPandasWithState(advance(days_to_live), OUTPUT, STATE, "append", timeout)
    return trends.withColumns({"alert_level": A.alert_level(F.col("risk")), "display_risk": A.display_risk(F.col("risk"), F.col("trend"))})


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def use_rocks_db(spark: SparkSession) -> None:
    """State stores of streams started from now on; list states and timers need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


class WindowProcessor(StatefulProcessor):
    """Rows of one machine wait in a list state until the watermark passes them; then each ends a window over the rows before it.

    A row is (microseconds, id, values). ``tail`` holds the last rows put out, at most as many as a window reaches back. One
    timer a machine and batch calls at its first waiting row, one more drops the tail of a machine silent for ``days_to_live``.
    """

    ROW = "at long, id long, step array<double>"

    def __init__(self, names: Sequence[str], cols: Sequence[str], n: int, min_rows: int, days_to_live: int | None):
        self.names, self.cols, self.n, self.min_rows, self.days_to_live = tuple(names), list(cols), n, min_rows, days_to_live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.ROW)
        self.tail = handle.getListState("tail", self.ROW)

    def rows(self, batch: pd.DataFrame) -> list[tuple]:
        _, ts, number = self.names
        at = pd.DatetimeIndex(batch[ts]).as_unit("us").asi8
        steps = batch[self.cols].astype(float).to_numpy()
        return [(int(a), int(i), [None if x != x else float(x) for x in step]) for a, i, step in zip(at, batch[number], steps)]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        past = sorted(self.rows(initialState), key=lambda r: r[:2])
        if past and self.n > 1:
            self.tail.put(past[1 - self.n :])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                fresh = self.rows(batch)
                self.open.appendList(fresh)
                first = min([r[0] for r in fresh] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        due = sorted((r for r in waiting if r[0] // 1000 <= passed), key=lambda r: r[:2])
        past = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        if not due:
            if self.days_to_live is not None and past and past[-1][0] // 1000 + self.days_to_live * DAY_MS <= passed:
                self.tail.clear()
            return
        left = [r for r in waiting if r[0] // 1000 > passed]
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(r[0] for r in left) // 1000)
        else:
            self.open.clear()
        known = [*past, *due]
        if self.n > 1:
            self.tail.put(known[1 - self.n :])
        if self.days_to_live is not None:
            self.handle.registerTimer(due[-1][0] // 1000 + self.days_to_live * DAY_MS)
        # A silence longer than the time to live starts a machine anew, whether or not its timer ran before these rows came.
        begin, spans = 0, []
        for e in range(1, len(known) + 1):
            if self.days_to_live is not None and e > 1 and known[e - 1][0] - known[e - 2][0] > self.days_to_live * DAY_MS * 1000:
                begin = e - 1
            if e > len(past) and min(e - begin, self.n) >= self.min_rows:
                spans.append((max(begin, e - self.n), e))
        if spans:
            name, ts, number = self.names
            yield pd.DataFrame({
                name: [key[0]] * len(spans),
                ts: pd.to_datetime([known[e - 1][0] for _, e in spans], unit="us"),
                number: [known[e - 1][1] for _, e in spans],
                "window": [[list(r[2]) for r in known[b:e]] for b, e in spans],
            })

    def close(self) -> None:
        pass


def window_state(
    stream: DataFrame, cols: Sequence[str], n: int = 24, min_rows: int = 2, scaler: DataFrame | None = None, delay: str = "7 days",
    days_to_live: int | None = None, history: DataFrame | None = None, names: Sequence[str] = ("machine_id", "ts", "event_id"),
) -> DataFrame:
    """Window of the last ``n`` rows at every tick, from ``min_rows`` rows on, as a stateful stream with event time.

    ``names`` are the key, the time and the id that orders rows of one time. Rows may come up to ``delay`` late and take their
    place in the order; later ones, and rows without a time, drop out. A window comes out when the watermark passes its last
    row. A machine silent for more than ``days_to_live`` starts anew. ``scaler`` is one row of means and deviations, ``history`` the rows of machines known before the stream starts. All
    rows of a machine that are still open lie in one task: use ``jobs.live_windows`` for hot machines.
    """
    key, ts, number = names
    use_rocks_db(stream.sparkSession)
    p = None if scaler is None else scaler.first()
    steps = [F.col(c).cast("double") if p is None else (F.col(c) - F.lit(p[f"mean_{c}"])) / F.lit(p[f"std_{c}"]) for c in cols]
    of = lambda df: df.filter(F.col(ts).isNotNull()).select(key, ts, number, *[x.alias(c) for x, c in zip(steps, cols)])
    output = f"{key} {stream.schema[key].dataType.simpleString()}, {ts} timestamp, {number} long, window array<array<double>>"
    known = None if history is None else of(history).groupBy(key)
    processor = WindowProcessor(names, cols, n, min_rows, days_to_live)
    return of(stream).withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(processor, output, "append", "EventTime", known)
