"""The history of chat sessions, kept in streaming state.

A session has one clock: it starts at a given time and each message moves it on by a minute, over midnight into the next day. A message is given
the session's earlier messages as its context. A reset message, or a pause longer than ``idle``, begins the session anew.

State is the open histories of ``2**BLOCK_BITS`` sessions with neighbouring numbers: what Python asks of the state store and the rows that it sends are then a few
messages for a block, not for each session. Once the watermark has passed a session's pause, its history is dropped with the next messages of its block,
and an event-time timer drops the block after the last pause, so sessions that ended cost nothing in the end.

Messages of a session are taken in order of time and number within a batch; a batch's messages are expected to be later than those of earlier batches,
and messages behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TURN = "session bigint, number bigint, turn int, clock timestamp, context string, text string"
#: Open sessions: the microsecond of the last message, turns and text of each.
STATE = "session array<bigint>, seen array<bigint>, turn array<int>, history array<string>"
#: Sessions to a row of state, as a power of two.
BLOCK_BITS = 5
#: Characters of context that are sent at once.
SENT = 4_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESET = "/reset"


class History(StatefulProcessor):
    """Turns of the sessions of a block out of their messages."""

    def __init__(self, start: datetime, idle: timedelta) -> None:
        self.start, self.idle = start, idle // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {s: x for s, *x in zip(*self.open.get(), strict=True)} if self.open.exists() else {}
        nameless, out, size = pd.isna(key[0]), [], 0
        messages = pd.concat(list(rows)).sort_values(["session", "moment", "number"])
        for session, number, moment, text in zip(*(messages[c].tolist() for c in ("session", "number", "moment", "text")), strict=True):
            seen, turn, history = known.get(session, (None, 0, ""))
            if text == RESET or (seen is not None and moment - seen > self.idle):
                turn, history = 0, ""
            if text != RESET:
                turn += 1
                out.append((None if nameless else session, number, turn, self.start + timedelta(minutes=turn), history, text))
                size += len(history)
                history = f"{history}\n{text}" if turn > 1 else text
            known[session] = (moment, turn, history)
            if size > SENT:
                yield _sent(out)
                out, size = [], 0
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [(s, *x) for s, x in known.items() if x[0] + self.idle >= passed]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.open.update(tuple(list(x) for x in zip(*kept, strict=True)))
            self.handle.registerTimer((max(x[1] for x in kept) + self.idle) // 1000 + 1)
        else:
            self.open.clear()
        yield _sent(out)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _sent(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "number", "turn", "clock", "context", "text"])


def turns(messages: DataFrame, start: datetime, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session, number, turn, clock, context, text) of messages(session, number, at, text), a stream or a table.

    A table is answered by windows, with the same rows as a stream whose batches come in order.
    """
    gap = pd.Timedelta(idle).to_pytimedelta()
    if messages.isStreaming:
        messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        # the sessions of no number are one, in a block of its own
        block, session = F.shiftright("session", BLOCK_BITS).alias("block"), F.coalesce("session", F.lit(0)).alias("session")
        each = messages.withWatermark("at", late).select(block, session, "number", "at", F.unix_micros("at").alias("moment"), "text")
        return each.groupBy("block").transformWithStateInPandas(History(start, gap), TURN, "Append", "EventTime")
    w = Window.partitionBy("session").orderBy("at", "number")
    earlier = F.lag("at").over(w)
    anew = (F.col("text") == RESET) | F.coalesce(F.col("at") - earlier > F.lit(gap), F.lit(False))
    part = messages.withColumn("anew", anew).withColumn("part", F.sum(F.col("anew").cast("int")).over(w)).where(F.col("text") != RESET)
    inside = Window.partitionBy("session", "part").orderBy("at", "number")
    said = F.collect_list("text").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    made = part.withColumn("turn", F.row_number().over(inside)).withColumn("context", F.array_join(said, "\n"))
    clock = F.lit(start).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn"))
    return made.select("session", "number", "turn", clock.alias("clock"), "context", "text")


def run(spark: SparkSession, folder: str, checkpoint: str, out: str, start: datetime, idle: str = "30 minutes", partitions: int | None = None) -> None:
    """Answer what is new in a folder of Parquet files of messages, and append the turns to ``out``.

    ``partitions`` of state are those of the session's shuffles unless given; a checkpoint keeps the number that it began with.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions or before))
    try:
        stream = spark.readStream.schema("session bigint, number bigint, at timestamp, text string").parquet(folder)
        made = turns(stream, start, idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        made.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
