import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from designlake.streaming import job_events

SF = "/root/testdata/sf0.001"


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_replay_of_a_table_counts_all_events(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "e"))
    e = job_events.replayed(spark, str(tmp_path / "e"), "3650 days")
    got = {(s, k): n for s, k, n in run(job_events.by_window(e), "windows", "complete")}
    want = {(r.s, r.event_type): r.n for r in spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("s"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_states_and_terminal_events(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    first = [(1, at(0), 1, "start", 0.0, ""), (2, at(1), 1, "done", 0.0, ""), (3, at(2), 1, "done", 0.0, ""), (4, at(2), 2, "start", 0.0, ""), (5, at(3), 1, "late step", 0.0, "")]
    later = [(6, at(120), 3, "start", 0.0, "")]
    for i, rows in enumerate((first, later)):
        spark.createDataFrame(rows, job_events.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        os.utime(max((tmp_path / "e").glob("*.parquet"), key=lambda p: p.stat().st_mtime), (1000 + i, 1000 + i))
    e = job_events.replayed(spark, str(tmp_path / "e"))
    done = run(job_events.terminal_once(e), "ends", "append")
    assert [(r[0], r[1]) for r in done] == [(1, "done")]
    got = run(job_events.states(e), "states", "update")
    final = {(j, s, n, x) for j, s, n, _, x in got}
    assert (1, "done", 2, False) in final and (2, "running", 1, False) in final and (3, "running", 1, False) in final
