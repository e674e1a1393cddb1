"""Reports kept up to date while data arrives.

Each takes a streaming DataFrame and returns one; the same functions accept a
batch DataFrame and then give the final figures.  Percentiles and totals by
rollup are not incremental and stay with the batch reports.

``delay`` bounds how late a row may be.  With it old state is dropped and rows
that come later than that are not counted; without it every row counts, which is
what a replay of stored files needs, since files are not read in event order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.latency import summary_aggregates, summary_figures
from loadlens.operators.records import last_writes


def _windowed(df: DataFrame, ts: str, width: str, delay: str | None) -> tuple[DataFrame, Column]:
    if delay is not None:
        df = df.withWatermark(ts, delay)
    return df, F.window(ts, width)


def stream_counts(
    df: DataFrame, ts: str, width: str = "1 second", delay: str | None = None
) -> DataFrame:
    """Records per interval."""
    df, window = _windowed(df, ts, width, delay)
    counts = df.groupBy(window.alias("window")).agg(F.count(F.lit(1)).alias("records"))
    return counts.select(F.col("window.start").alias("window_start"), "records")


def stream_throughput(
    df: DataFrame, ts: str, line: str, width: str = "1 second", delay: str | None = None
) -> DataFrame:
    """Per interval: records and bytes per second, and mean size of a line."""
    df, window = _windowed(df, ts, width, delay)
    sums = df.groupBy(window.alias("window")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(line)).alias("bytes")
    )
    seconds = (
        F.unix_micros("window.end") - F.unix_micros("window.start")
    ) / 1_000_000
    return sums.select(
        F.col("window.start").alias("window_start"),
        "records",
        (F.col("records") / seconds).alias("records_per_s"),
        (F.col("bytes") / seconds).alias("bytes_per_s"),
        (F.col("bytes") / F.col("records")).alias("mean_size"),
    )


def stream_summary(requests: DataFrame) -> DataFrame:
    """Latency summary per label."""
    report = requests.groupBy("label").agg(*summary_aggregates())
    return summary_figures(report, F.col("label"))


def stream_kv_state(ops: DataFrame) -> DataFrame:
    """Last write of each key so far."""
    return last_writes(ops)


def stream_ready(logs: DataFrame, pattern: str) -> DataFrame:
    """First time a node's log shows the ready line."""
    ready = logs.where(F.col("line").rlike(pattern))
    return ready.groupBy("node").agg(F.min("ts").alias("ready_at"))


def stream_sessions(df: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions of each key: rows less than ``gap`` apart; given out once the watermark has passed them."""
    session = F.session_window(ts, gap)
    found = df.withWatermark(ts, delay).groupBy(session.alias("session"), key).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("rows")
    )
    return found.select(key, "first", "last", "rows")


def stream_band_join(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, after: str, delay: str
) -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same key at most ``after`` later, or with none.

    Both sides wait in state until the watermark says that no partner can come; a row without one is then given
    out, late, with NULLs.  ``after`` and ``delay`` are intervals such as ``6 hours``.
    """
    a = left.withWatermark(left_time, delay)
    b = right.withColumnRenamed(key, "_key").withWatermark(right_time, delay)
    apart = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {after}"))
    return a.join(b, (F.col(key) == F.col("_key")) & apart, "leftOuter").drop("_key")


def stream_not_ready(logs: DataFrame, pattern: str, wait_s: int, delay: str) -> DataFrame:
    """Nodes without a ready line ``wait_s`` seconds after their first line: node, deadline; each once.

    A node keeps its deadline and whether it is done; a timer in event time reports it when
    the watermark passes the deadline.  ``logs`` (node, ts, line) has each node's first line first.
    """
    lines = logs.withWatermark("ts", delay)
    lines = lines.select("node", "ts", F.unix_micros("ts").alias("us"), F.col("line").rlike(pattern).alias("ready"))

    def watch(key, frames, state):
        deadline, done = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            state.update((deadline, True))
            yield pd.DataFrame({"node": [key[0]], "deadline": [deadline]})
            return
        ready: list[int] = []
        for frame in frames:
            times = frame["us"].to_numpy()
            if deadline is None:
                deadline = int(times.min()) + wait_s * 1_000_000
            ready += times[frame["ready"].to_numpy()].tolist()
        done = done or any(t <= deadline for t in ready)
        overdue = not done and state.getCurrentWatermarkMs() * 1000 > deadline
        state.update((deadline, done or overdue))
        if overdue:
            yield pd.DataFrame({"node": [key[0]], "deadline": [deadline]})
        elif not done:
            # The first millisecond after the deadline.
            state.setTimeoutTimestamp(deadline // 1000 + 1)

    kind = logs.schema["node"].dataType.simpleString()
    late = lines.groupBy("node").applyInPandasWithState(
        watch, f"node {kind}, deadline long", "deadline long, done boolean", "append", "EventTimeTimeout"
    )
    return late.select("node", F.timestamp_micros("deadline").alias("deadline"))
