"""The telemetry aggregates as Structured Streaming: watermarked daily windows, exactly-once rows, stateful alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.telemetry import LOW


def distinct_rows(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows by id, once; later copies within the watermark are dropped."""
    return stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def daily(stream: DataFrame, late: str = "1 hour", low: float = LOW) -> DataFrame:
    """Requests, scores and durations of each day and tool.  State is one small row per open window and tool."""
    marked = stream.withWatermark("created_at", late)
    grouped = marked.groupBy(F.window("created_at", "1 day").alias("w"), "tool_name").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("top_score").alias("mean_score"),
        F.max("top_score").alias("max_score"),
        F.sum((F.col("top_score").isNull() | (F.col("top_score") < low)).cast("int")).alias("low_scores"),
        F.percentile_approx("duration_ms", 0.95, 10000).alias("p95_ms"),
    )
    return grouped.select(F.col("w.start").alias("day"), "tool_name", "requests", "mean_score", "max_score", "low_scores", "p95_ms")


def totals(stream: DataFrame, late: str = "1 hour", low: float = LOW, by: tuple[str, ...] = ()) -> DataFrame:
    """The measures of each day over all tools, or by the columns ``by`` (tool_name, retrieval_mode): the streamed breakdown."""
    marked = stream.withWatermark("created_at", late)
    grouped = marked.groupBy(F.window("created_at", "1 day").alias("w"), *by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("top_score").alias("mean_score"),
        F.max("top_score").alias("max_score"),
        F.sum((F.col("top_score").isNull() | (F.col("top_score") < low)).cast("int")).alias("low_scores"),
        F.avg("duration_ms").alias("mean_ms"),
        F.percentile_approx("duration_ms", 0.5, 10000).alias("p50_ms"),
        F.percentile_approx("duration_ms", 0.95, 10000).alias("p95_ms"),
    )
    return grouped.select(F.col("w.start").alias("day"), *by, "requests", "mean_score", "max_score", "low_scores", "mean_ms", "p50_ms", "p95_ms")


def alerts(stream: DataFrame, run: int = 10, low: float = LOW, late: str = "1 hour", idle: str = "7 days") -> DataFrame:
    """repo_id, id, created_at when ``run`` low scores stand in a row.  State is the length of the current run.

    Rows of a micro-batch are taken in order of time; rows that come later than ones already seen count when they come.  The
    state of a repository that is silent for ``idle`` of event time is dropped: its next run starts from nothing.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["repo_id", "id", "created_at"])
            return
        length, last = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["created_at", "id"])
        found = []
        for row in rows.itertuples():
            bad = row.top_score is None or row.top_score != row.top_score or row.top_score < low
            length = length + 1 if bad else 0
            if length == run:
                found.append((key[0], row.id, row.created_at))
        last = max(last, int(rows["created_at"].max().timestamp() * 1000))
        state.update((length, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["repo_id", "id", "created_at"])

    marked = stream.withWatermark("created_at", late)
    return marked.groupBy("repo_id").applyInPandasWithState(step, "repo_id long, id long, created_at timestamp", "length int, last long", "append", "EventTimeTimeout")
