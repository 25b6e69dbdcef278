"""Usage telemetry by time windows; the same functions take batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def on_time(events: DataFrame, late: str | None = None) -> DataFrame:
    """events with ts as a timestamp, and a watermark on streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if late and events.isStreaming else e


def _sums(value: str) -> list[Column]:
    return [F.count("*").alias("calls"), F.sum(value).alias("total")]


def tumbling(events: DataFrame, width: str, by: list[str], value: str = "value", late: str | None = "1 hour") -> DataFrame:
    g = on_time(events, late).groupBy(F.window("ts", width).alias("w"), *by).agg(*_sums(value))
    return g.select(F.col("w.start").alias("window_start"), *by, "calls", "total")


def sliding(events: DataFrame, width: str, step: str, by: list[str], value: str = "value", late: str | None = "1 hour") -> DataFrame:
    g = on_time(events, late).groupBy(F.window("ts", width, step).alias("w"), *by).agg(*_sums(value))
    return g.select(F.col("w.start").alias("window_start"), *by, "calls", "total")


def sessions(events: DataFrame, gap: str, by: list[str], value: str = "value", late: str | None = "1 hour") -> DataFrame:
    g = on_time(events, late).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(*_sums(value))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "calls", "total")


def rate_limited(requests: DataFrame, limits: list[tuple[int, float]], late: str = "1 hour") -> DataFrame:
    """api_key, model_name, ts, admitted: each request of a stream against sliding windows of its key and model.

    State holds the admitted times within the longest period; it goes once the watermark is that far beyond the last of them.
    A request exactly one period after an admitted one no longer counts that one. Requests that are later than the watermark are dropped.
    """
    longest = max((p for _, p in limits), default=0.0)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values("ts")
        out = []
        for t in rows["ts"]:
            now = t.timestamp()
            used = [x for x in used if x > now - longest]
            ok = all(sum(x > now - p for x in used) < n for n, p in limits)
            if ok:
                used.append(now)
            out.append(ok)
        if used:
            state.update((used,))
            state.setTimeoutTimestamp(max(int((used[-1] + longest + 1) * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"api_key": key[0], "model_name": key[1], "ts": rows["ts"].to_numpy(), "admitted": out})

    # the watermark's clock is a second ahead of ts, since what lies at its first value of zero counts as late
    clocked = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_clock", F.col("ts") + F.expr("INTERVAL 1 SECOND")).withWatermark("_clock", late)
    return clocked.groupBy("api_key", "model_name").applyInPandasWithState(step, "api_key string, model_name string, ts timestamp, admitted boolean", "used array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_state(log: DataFrame) -> DataFrame:
    """The latest status, message and progress of each task of a stream or batch of task events."""
    order = F.struct("ts", "seq")
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("status", "message", "progress")]
    g = on_time(log).groupBy("task_id").agg(*latest)
    return g.withColumn("progress", F.when(F.col("status").isin("completed", "failed"), 100.0).otherwise(F.col("progress")))
