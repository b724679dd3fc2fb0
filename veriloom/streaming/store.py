"""A trace store as a stream: typed state per trace, with timers for expiry.

A trace is what one id's events make of a small state: how many were accepted (their numbers go from
1 without a gap), when the first and the last happened, and its status, which is that of the last terminal
event, else running. Each micro-batch tells what changed:

    event     an accepted event, with its seq
    full      the trace has max_events; this and later events are refused (counted, not numbered)
    snapshot  the trace as it is after the batch
    expired   the trace as it was when it had been silent for ttl; its state is gone

Expiry follows event time: an event that comes more than ttl after the one before it finds its trace expired
and begins anew, whether both are in one batch or not, and a trace without further events expires when the
watermark has passed. So rows depend on the events and their order, not on how they are cut into batches.

With processing time in its place, state has a time to live of its own and vanishes without a row; such a
stream never runs out of batches, so run_store() takes event time alone.

Memory: one trace's events of one micro-batch; state is one row per trace that is not expired.
State is kept by RocksDB (with_state_store()) and survives restarts through the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .traces import TERMINAL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "n_events long, refused long, created_us long, updated_us long, status string"
TOLD = "kind string, event_id long, seq long, n_events long, refused long, created_us long, updated_us long, status string"


@contextmanager
def with_state_store(spark: SparkSession):
    """The state store that typed state needs, while a query starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class TraceProcessor(StatefulProcessor):
    """The state machine of one trace."""

    def __init__(self, ttl_us: int | None, max_events: int | None, event_time: bool):
        self.ttl_us, self.max_events, self.event_time = ttl_us, max_events, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = None if self.event_time or self.ttl_us is None else self.ttl_us // 1000
        self.trace = handle.getValueState("trace", STATE, own)

    def _row(self, kind: str, state: list | None, event_id: int | None = None, seq: int | None = None) -> tuple:
        return (kind, event_id, seq, *(state or (None,) * 5))

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in TOLD.split(", ")]).astype({c: "Int64" for c in ("event_id", "seq", "n_events", "refused", "created_us", "updated_us")})
        out.insert(0, "trace_id", key[0])
        return out

    def _expiry(self) -> None:
        """No timer stands any more."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = list(self.trace.get()) if self.trace.exists() else None
        told = []
        for event in pd.concat(list(rows)).sort_values(["ts_us", "event_id"], kind="stable").itertuples(index=False):
            if state is not None and self.event_time and self.ttl_us is not None and event.ts_us > state[3] + self.ttl_us:
                told.append(self._row("expired", state))
                state = None
            state = state or [0, 0, event.ts_us, event.ts_us, "running"]
            if self.max_events is not None and state[0] >= self.max_events:
                if not state[1]:
                    told.append(self._row("full", state))
                state[1] += 1
                continue
            state[0] += 1
            state[2], state[3] = min(state[2], event.ts_us), max(state[3], event.ts_us)
            if event.status in TERMINAL:
                state[4] = event.status
            told.append(self._row("event", state, event.event_id, state[0]))
        told.append(self._row("snapshot", state))
        self.trace.update(tuple(state))
        if self.event_time and self.ttl_us is not None:
            self._expiry()
            # a timer fires when the watermark, in whole milliseconds, is beyond it
            self.handle.registerTimer((state[3] + self.ttl_us) // 1000)
        yield self._frame(key, told)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.trace.exists():
            state = list(self.trace.get())
            self.trace.clear()
            yield self._frame(key, [self._row("expired", state)])

    def close(self) -> None:
        pass


def trace_store(events: DataFrame, ttl_seconds: int | None = None, max_events: int | None = None, late: str = "0 seconds", event_time: bool = True) -> DataFrame:
    """The rows that a stream of events (trace_id, event_id, ts, status) makes the store tell, in append mode.

    late: how far event time may run behind before an event is dropped.
    """
    kind = events.schema["trace_id"].dataType.simpleString()
    rows = events.select("trace_id", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "status").withColumn("ts_us", F.unix_micros("ts"))
    if event_time:
        rows = rows.withWatermark("ts", late)
    processor = TraceProcessor(None if ttl_seconds is None else ttl_seconds * 1_000_000, max_events, event_time)
    timed = "EventTime" if event_time else "ProcessingTime"
    return rows.groupBy("trace_id").transformWithStateInPandas(processor, f"trace_id {kind}, {TOLD}", "Append", timed)


def run_store(events: DataFrame, path: str, checkpoint: str, **settings) -> None:
    """All that the stream holds by now, told into parquet files under path; called again, what came since."""
    if not settings.get("event_time", True):
        raise ValueError("a stream over processing time does not end")
    with with_state_store(events.sparkSession):
        query = trace_store(events, **settings).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def latest(told: DataFrame) -> DataFrame:
    """The newest snapshot of each trace, with expired: whether nothing came since it expired."""
    rows = told.filter(F.col("kind").isin("snapshot", "expired"))
    newest = F.struct("updated_us", F.col("n_events") + F.col("refused"), F.col("kind") == "expired")
    held = F.struct("n_events", "refused", "created_us", "updated_us", "status", (F.col("kind") == "expired").alias("expired"))
    return rows.groupBy("trace_id").agg(F.max_by(held, newest).alias("r")).select("trace_id", "r.*")
