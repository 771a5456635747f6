"""Streams of pulses and task states.  Event time is a timestamp column ``ts``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The states of a task, and which may follow which.
NEXT = {"new": ("pending", "submitted", "aborted"), "pending": ("submitted", "aborted"), "submitted": ("running", "aborted", "failed", "completed"), "running": ("completed", "failed", "aborted"), "aborted": ("pending",), "failed": ("pending",), "completed": ()}


def with_event_time(stream: DataFrame, column: str = "ts", late: str = "1 minute") -> DataFrame:
    """A watermark; times without zone are read in the session's."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def alarms(stream: DataFrame, max_cpu: float | None = None, max_mem: int | None = None) -> DataFrame:
    """(task_id, ts, what, value): samples over a limit.  Nothing is stopped."""
    found = []
    if max_cpu is not None:
        found.append(F.when(F.col("cpu") > max_cpu, F.struct(F.lit("cpu").alias("what"), F.col("cpu").cast("double").alias("value"))))
    if max_mem is not None:
        found.append(F.when(F.col("mem") > max_mem, F.struct(F.lit("mem").alias("what"), F.col("mem").cast("double").alias("value"))))
    listed = stream.select("task_id", "ts", F.explode(F.array(*found)).alias("a")).where(F.col("a").isNotNull())
    return listed.select("task_id", "ts", "a.what", "a.value")


def overdue(stream: DataFrame, seconds: float) -> DataFrame:
    """(task_id, ts, elapsed): the first sample of a task that comes later than ``seconds`` after its first."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, told = state.get if state.exists else (None, False)
        times = sorted(t.timestamp() for part in parts for t in part["ts"])
        out = []
        for t in times:
            start = t if start is None else min(start, t)
            if not told and t - start > seconds:
                out.append((key[0], pd.Timestamp(round(t * 1_000_000), unit="us"), t - start))
                told = True
        state.update((start, told))
        yield pd.DataFrame(out, columns=["task_id", "ts", "elapsed"])

    return stream.groupBy("task_id").applyInPandasWithState(step, "task_id long, ts timestamp, elapsed double", "start double, told boolean", "append", GroupStateTimeout.NoTimeout)


def silent(stream: DataFrame, seconds: int) -> DataFrame:
    """(task_id, last): tasks from which nothing came for ``seconds`` of event time; needs a watermark."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(round(last * 1_000_000), unit="us"))], columns=["task_id", "last"])
            return
        last = state.get[0] if state.exists else 0.0
        for part in parts:
            last = max([last, *(t.timestamp() for t in part["ts"])])
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["task_id", "last"])

    return stream.groupBy("task_id").applyInPandasWithState(step, "task_id long, last timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def transitions(stream: DataFrame) -> DataFrame:
    """(task_id, ts, old, status, legal): every change of a task's status, in time order inside a batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else "new"
        rows = sorted((t, s) for part in parts for t, s in zip(part["ts"], part["status"], strict=True))
        out = []
        for ts, status in rows:
            if status != old:
                out.append((key[0], ts, old, status, status in NEXT.get(old, ())))
                old = status
        state.update((old,))
        yield pd.DataFrame(out, columns=["task_id", "ts", "old", "status", "legal"])

    return stream.groupBy("task_id").applyInPandasWithState(step, "task_id long, ts timestamp, old string, status string, legal boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, width: str, by: list[str], slide: str | None = None) -> DataFrame:
    """EXT: counts in tumbling or sliding windows of event time."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
