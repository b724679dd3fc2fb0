"""Trace stores: numbered events, expiry, eviction, snapshots and tails; batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def numbered(events: DataFrame, trace: str = "trace_id", *order: str, max_events: int | None = None) -> DataFrame:
    """seq from 1 per trace; a trace with more than max_events raises."""
    rows = events.withColumn("seq", F.row_number().over(Window.partitionBy(trace).orderBy(*order)))
    if max_events:
        rows = rows.filter(F.assert_true(F.col("seq") <= max_events, F.lit("trace has too many events")).isNull())
    return rows


def expired(snapshots: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Traces last updated before now minus the time to live."""
    return snapshots.filter(F.col("updated_at") < now - F.make_interval(secs=F.lit(ttl_seconds)))


def live(snapshots: DataFrame, now: Column, ttl_seconds: int, max_traces: int | None = None) -> DataFrame:
    """What a store keeps: not expired, and of those the max_traces created last."""
    rows = snapshots.filter(F.col("updated_at") >= now - F.make_interval(secs=F.lit(ttl_seconds)))
    # one ordered limit: no task sees all traces
    return rows.orderBy(F.col("created_at").desc(), F.col("trace_id").desc()).limit(max_traces) if max_traces else rows


def snapshots(events: DataFrame, trace: str = "trace_id", ts: str = "ts") -> DataFrame:
    """Per trace: events, first and last time, and status: the last terminal one, else running."""
    terminal = F.when(F.col("status").isin(*TERMINAL), F.col("status"))
    return events.groupBy(F.col(trace).alias("trace_id")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.max("seq").alias("last_seq"), F.coalesce(F.max_by(terminal, F.when(terminal.isNotNull(), F.col("seq"))), F.lit("running")).alias("status"))


def tail(events: DataFrame, after: Column | int) -> DataFrame:
    """Events beyond a reader's last sequence number."""
    return events.filter(F.col("seq") > after)


def drained(snapshot: DataFrame, last_seen: str = "last_seen") -> DataFrame:
    """Whether a reader may end: terminal, and nothing beyond what it has seen."""
    return snapshot.withColumn("drained", F.col("status").isin(*TERMINAL) & (F.col("last_seq") <= F.coalesce(F.col(last_seen), F.lit(0))))


def sessions(events: DataFrame, ttl: str = "30 minutes", trace: str = "trace_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """Time to live as a session gap: a trace that was silent for it begins anew.

    With a lateness the input may be a stream: a session is emitted when the watermark has passed it.
    """
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    out = rows.groupBy(F.session_window("_ts", ttl).alias("w"), trace).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(trace, F.col("w.start").alias("created_at"), F.col("w.end").alias("expires_at"), "n_events")


def _count_on(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else 0
    for frame in frames:
        frame = frame.sort_values(["ts", "event_id"], ignore_index=True)
        frame["seq"] = range(seen + 1, seen + 1 + len(frame))
        seen += len(frame)
        yield frame
    state.update((seen,))


def numbered_stream(events: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Numbers a stream's events per trace over micro-batches; the counter is the only state.

    events: trace, event_id, ts and any other columns.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes) + ", seq long"
    return events.groupBy(trace).applyInPandasWithState(_count_on, schema, "seen long", "append", "NoTimeout")


def windowed_counts(events: DataFrame, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", *by: str) -> DataFrame:
    """Tumbling or sliding counts with a watermark, for monitoring a trace stream."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(F.window("_ts", window, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
