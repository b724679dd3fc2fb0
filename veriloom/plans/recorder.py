"""A run's recorder: named stages become Spark job tags and rows of an event table.

Without an active recorder every call does nothing, so that operators can record freely.
"""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

_active: ContextVar[Recorder | None] = ContextVar("veriloom_recorder", default=None)
EVENT = "trace_id string, seq int, ts timestamp, stage string, event string, status string, elapsed_ms double, payload string"
LEVELS = ("summary", "sampled", "full")


class Recorder:
    def __init__(self, spark: SparkSession, trace_id: str, level: str = "sampled", max_events: int = 1000):
        if level not in LEVELS:
            raise ValueError(f"level is one of: {', '.join(LEVELS)}")
        self.spark, self.trace_id, self.level, self.max_events = spark, trace_id, level, max_events
        self.rows: list[tuple] = []

    def emit(self, stage: str, event: str, status: str = "running", elapsed_ms: float | None = None, payload: dict | None = None) -> None:
        """More than max_events raise; the end of a trace is always kept, so that none stays running."""
        if len(self.rows) >= self.max_events and status == "running":
            raise RuntimeError(f"trace {self.trace_id} has more than {self.max_events} events")
        self.rows.append((self.trace_id, len(self.rows) + 1, datetime.now(timezone.utc), stage, event, status, elapsed_ms, json.dumps(payload or {}, default=str, sort_keys=True)))

    def events(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, EVENT)

    @contextmanager
    def active(self):
        """Makes this the recorder of the block; its end completes or fails the trace."""
        token = _active.set(self)
        try:
            yield self
            self.emit("trace", "trace.completed", "completed")
        except Exception as error:
            self.emit("trace", "trace.failed", "failed", payload={"error": type(error).__name__})
            raise
        finally:
            _active.reset(token)


def record(stage: str, event: str, **payload) -> None:
    if recorder := _active.get():
        recorder.emit(stage, event, payload=payload)


@contextmanager
def stage(name: str):
    """A stage of a run: its jobs carry the name as a tag, its time becomes an event."""
    recorder = _active.get()
    if recorder is None:
        yield
        return
    tag = f"veriloom-{name}"
    recorder.spark.addTag(tag)
    began = time.perf_counter()
    recorder.emit(name, f"{name}.started")
    try:
        yield
        recorder.emit(name, f"{name}.completed", elapsed_ms=round((time.perf_counter() - began) * 1000, 3))
    finally:
        recorder.spark.removeTag(tag)
