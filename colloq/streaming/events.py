"""Structured Streaming over event tables; the reference of this engine has none, so these are extras.

Each function is a transformation that works on static and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def source(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows; events later than ``late`` are dropped when streaming."""
    w = F.window("ts", size)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per user sessions that end after ``gap`` without an event."""
    w = F.session_window("ts", gap)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """Per user the number of events and the sum so far, kept in state (streaming only)."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
