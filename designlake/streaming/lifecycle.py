"""Requests and jobs as streams with state that expires by event time, and the joins that restore finished work.

State is one small value a key, kept in the state store with a timer: a request goes once nothing has happened to it for
its time to live, a job once that much has passed since its end (or creation). Rows come out in update mode, so a key's last
row is what holds. Replaying the same events gives the same last rows, in whatever batches they come, as long as each key's
events come in order; of one batch they are put in order here.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import JOB_MINUTES, MOST_PENDING, REQUEST_MINUTES, TERMINAL

STATUS = {"create": "pending", "claim": "claimed", "complete": "done", "decline": "declined"}
REQUEST = "request long, status string, created_at timestamp, updated_at timestamp, refused long, expired boolean"
JOB = "job long, since timestamp, status string, expired boolean"
QUEUE = "queue long, request long, status string, created_at timestamp, updated_at timestamp, reason string"


def millis(t: dt.datetime) -> int:
    """As event time is counted; times without a zone are local ones, as rows have them."""
    return int(t.timestamp() * 1000)


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.at, r.seq))


class _Keyed(StatefulProcessor):
    """A value state and at most one timer a key."""

    schema = ""
    minutes = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def wake(self, was: dt.datetime | None, at: dt.datetime) -> None:
        """The timer of a key: a millisecond after `minutes` have passed since at, in place of the one for was."""
        when = lambda t: millis(t) + self.minutes * 60_000 + 1
        if was is None or when(was) != when(at):
            if was is not None:
                self.handle.deleteTimer(when(was))
            self.handle.registerTimer(when(at))

    def close(self) -> None:
        pass


class Requests(_Keyed):
    schema = "status string, created timestamp, updated timestamp, refused long"

    def __init__(self, minutes: int):
        self.minutes = minutes

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, created, was, refused = self.state.get() or (None, None, None, 0)
        updated = was
        for r in in_order(rows):
            if (status is None) != (r.action == "create") or status in ("done", "declined"):
                refused += 1
            else:
                status, created, updated = STATUS[r.action], created or r.at, r.at
        self.state.update((status, created, updated, refused))
        if updated is not None:
            self.wake(was, updated)
        yield Row(request=key[0], status=status, created_at=created, updated_at=updated, refused=refused, expired=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, created, updated, refused = self.state.get()
        self.state.clear()
        yield Row(request=key[0], status=status, created_at=created, updated_at=updated, refused=refused, expired=True)


class Jobs(_Keyed):
    schema = "since timestamp, status string"

    def __init__(self, minutes: int, terminal: tuple[str, ...]):
        self.minutes, self.terminal = minutes, terminal

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was, status = self.state.get() or (None, None)
        since = was
        for r in in_order(rows):
            if status in self.terminal:
                break
            status = r.state if r.state in self.terminal else "running"
            if since is None or status in self.terminal:
                since = r.at
        self.state.update((since, status))
        self.wake(was, since)
        yield Row(job=key[0], since=since, status=status, expired=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        since, status = self.state.get()
        self.state.clear()
        yield Row(job=key[0], since=since, status=status, expired=True)


class Queue(StatefulProcessor):
    """A queue's requests: at most `most` of them wait at a time, further ones are refused until one is taken or gone."""

    def __init__(self, minutes: int, most: int):
        self.minutes, self.most = minutes, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("requests", "request long", "status string, created timestamp, updated timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = {k[0]: tuple(v) for k, v in self.kept.iterator()}
        before = dict(kept)
        told = lambda r, v, why=None: Row(queue=key[0], request=r, status=v[0], created_at=v[1], updated_at=v[2], reason=why)
        for r in in_order(rows):
            for k in [k for k, v in kept.items() if millis(v[2]) + self.minutes * 60_000 < millis(r.at)]:
                yield told(k, kept.pop(k), "expired")
            known = kept.get(r.request)
            if r.action == "create" and known is None:
                if sum(v[0] == "pending" for v in kept.values()) >= self.most:
                    yield told(r.request, ("refused", r.at, r.at), f"{self.most} captures are already waiting")
                else:
                    kept[r.request] = ("pending", r.at, r.at)
                    yield told(r.request, kept[r.request])
            elif r.action != "create" and known is not None and known[0] in ("pending", "claimed"):
                kept[r.request] = (STATUS[r.action], known[1], r.at)
                yield told(r.request, kept[r.request])
        for k in before.keys() - kept.keys():
            self.kept.removeKey((k,))
        for k, v in kept.items():
            if before.get(k) != v:
                self.kept.updateValue((k,), v)

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, key: str, processor: StatefulProcessor, out: str) -> DataFrame:
    return events.groupBy(key).transformWithState(processor, out, "Update", "eventTime")


def requests(events: DataFrame, minutes: int = REQUEST_MINUTES) -> DataFrame:
    """REQUEST rows from a stream of request, action, at, seq with a watermark on at."""
    return _stateful(events, "request", Requests(minutes), REQUEST)


def jobs(events: DataFrame, minutes: int = JOB_MINUTES, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """JOB rows from a stream of job, state, at, seq with a watermark on at."""
    return _stateful(events, "job", Jobs(minutes, terminal), JOB)


def admitted(events: DataFrame, minutes: int = REQUEST_MINUTES, most: int = MOST_PENDING) -> DataFrame:
    """QUEUE rows, one for each change, from a stream of queue, request, action, at, seq with a watermark on at."""
    return _stateful(events, "queue", Queue(minutes, most), QUEUE)


def restored(asked: DataFrame, stored: DataFrame, before: str, after: str) -> DataFrame:
    """job, asked_at, stored_at, result: each question (job, asked_at) with the results (of, stored_at, result) that were stored
    from `before` ahead of it to `after` behind it, or once with nulls. Both are streams with watermarks; a question waits
    in state until the results' event time has passed it by `after`, so files that come late are still found."""
    near = (F.col("stored_at") >= F.col("asked_at") - F.expr(f"interval {before}")) & (F.col("stored_at") <= F.col("asked_at") + F.expr(f"interval {after}"))
    return asked.join(stored, (F.col("job") == F.col("of")) & near, "left").select("job", "asked_at", "stored_at", "result")


def source(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """All files at path as a stream, at most `files` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
