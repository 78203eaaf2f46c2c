"""State of jobs and of capture requests from append-only events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How long finished jobs and idle requests are kept, and how many requests may wait.
JOB_MINUTES, REQUEST_MINUTES, MOST_PENDING = 30, 60, 25
TERMINAL = ("done", "error")


def latest(events: DataFrame, job: str, at: str, seq: str, state: str) -> DataFrame:
    """Number of events and last state of each job; of equal times the greatest seq counts."""
    last = F.max(F.struct(at, seq, state)).alias("last")
    return events.groupBy(job).agg(F.count("*").alias("n_events"), last).select(job, "n_events", F.col(f"last.{state}").alias("state"), F.col(f"last.{at}").alias("at"))


def until_terminal(events: DataFrame, job: str, at: str, seq: str, state: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """The events of each job up to and with the first terminal one; what comes later is dropped."""
    before = Window.partitionBy(job).orderBy(at, seq).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col(state).isin(*terminal).cast("int")).over(before), F.lit(0))
    return events.withColumn("over", over).where("over = 0").drop("over")


def swept(events: DataFrame, job: str, at: str, seq: str, state: str, minutes: int = JOB_MINUTES, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """job, since, expired: the time a job counts from (its end, else its creation) and whether it is older than the newest
    event of all by more than `minutes`."""
    e = until_terminal(events, job, at, seq, state, terminal)
    j = e.groupBy(job).agg(F.coalesce(F.max(F.when(F.col(state).isin(*terminal), F.col(at))), F.min(at)).alias("since"))
    now = events.agg(F.max(at).alias("now"))
    # one row: the newest time
    return j.join(F.broadcast(now)).select(job, "since", (F.col("since") < F.col("now") - F.expr(f"interval {minutes} minutes")).alias("expired"))


def expired(jobs: DataFrame, at: str, minutes: int) -> DataFrame:
    """Jobs whose last event is older than the newest event of all by more than `minutes`."""
    now = jobs.agg(F.max(at).alias("now"))
    # one row: the newest time
    return jobs.join(F.broadcast(now)).where(F.col(at) < F.col("now") - F.expr(f"interval {minutes} minutes")).drop("now")


def requests(events: DataFrame, key: str, at: str, seq: str, action: str) -> DataFrame:
    """key, status, created_at, updated_at, refused: each request after its actions in order (create, claim, complete, decline).

    A created request is pending; a claim makes it claimed, and either may be completed (done) or declined. After that
    nothing changes it; such actions are counted as refused, and so are those before its creation.
    """
    order = Window.partitionBy(key).orderBy(at, seq)
    made = F.min(F.when(F.col(action) == "create", F.struct(at, seq))).over(Window.partitionBy(key))
    e = events.withColumn("made", made).withColumn("here", F.struct(at, seq))
    live = F.col("made").isNotNull() & (F.col("here") >= F.col("made"))
    final = F.col(action).isin("complete", "decline")
    ended = F.coalesce(F.max((live & final).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    counts = live & ~ended & ((F.col(action) != "create") | (F.col("here") == F.col("made")))
    e = e.withColumn("counts", counts)
    last = F.max(F.when(F.col("counts"), F.struct(at, seq, action))).alias("last")
    g = e.groupBy(key).agg(last, F.min("made")[at].alias("created_at"), F.sum((~F.col("counts")).cast("int")).alias("refused"))
    status = F.when(F.col(f"last.{action}") == "create", "pending").when(F.col(f"last.{action}") == "claim", "claimed").when(F.col(f"last.{action}") == "complete", "done").when(F.col(f"last.{action}") == "decline", "declined")
    return g.select(key, status.alias("status"), "created_at", F.col(f"last.{at}").alias("updated_at"), "refused")


def waiting(states: DataFrame, now, minutes: int = REQUEST_MINUTES) -> DataFrame:
    """The pending requests that have not been idle for over `minutes` at time now; readers sort them by created_at."""
    return states.where((F.col("status") == "pending") & (F.col("updated_at") >= now - F.expr(f"interval {minutes} minutes")))
