"""Job events as a stream: replayed from the start, each terminal event once, late ones dropped, counts by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import JOB_MINUTES, TERMINAL

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
STATE = "status string, n long, at timestamp"
OUT = "job long, status string, n long, at timestamp, evicted boolean"


def replayed(spark: SparkSession, path: str, delay: str = "10 minutes", schema: str = SCHEMA) -> DataFrame:
    """job, step, at, seq of all files at path, then of new ones; events later than delay are dropped by what follows."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.select(F.col("user_id").alias("job"), F.col("event_type").alias("step"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq")).withWatermark("at", delay)


def terminal_once(events: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """The first terminal event of each kind of each job within the watermark."""
    return events.where(F.col("step").isin(*terminal)).dropDuplicatesWithinWatermark(["job", "step"])


def by_window(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """start, step, n: events by tumbling window."""
    return events.groupBy(F.window("at", length).alias("w"), "step").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "step", "n")


def states(events: DataFrame, minutes: int = JOB_MINUTES, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Each job's state after each batch: running until a terminal event, which nothing changes; evicted once event time has
    passed its last change by `minutes`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, n, at = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "status": [status], "n": [n], "at": [at], "evicted": [True]})
            return
        status, n, at = state.get if state.exists else ("queued", 0, pd.Timestamp(0))
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        for s, t in zip(rows["step"], rows["at"]):
            if status in terminal:
                break
            status, n, at = (s if s in terminal else "running"), n + 1, t
        state.update((status, n, at))
        state.setTimeoutTimestamp(max(int(at.timestamp() * 1000) + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "n": [n], "at": [at], "evicted": [False]})

    return events.groupBy("job").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
