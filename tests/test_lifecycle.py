"""Streams with expiring state, result files and restored jobs: several batches, re-runs, late files, against plain loops."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from designlake.sources import results
from designlake.streaming import lifecycle

T0 = dt.datetime(2024, 1, 1)
EVENTS = "key long, request long, action string, ts timestamp, seq long"


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def arrive(spark, path, rows, schema, order):
    """One file of rows, the order-th to arrive."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    new = max(path.glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    os.utime(new, (1000 + order, 1000 + order))


def events(spark, path, *columns):
    d = lifecycle.source(spark, str(path), EVENTS, 1)
    return d.select(*columns, F.col("ts").alias("at"), "seq").withWatermark("at", "0 seconds")


def last(spark, rows, tmp_path, keys):
    results.stream_to(rows, results.keeping(str(tmp_path / "out")), str(tmp_path / "check"), "update")
    return results.last_rows(spark, str(tmp_path / "out"), keys).collect()


def test_requests_expire_and_start_anew(spark, tmp_path):
    batches = [
        [(1, 1, "create", at(0), 1), (1, 1, "create", at(1), 2), (2, 2, "claim", at(1), 3), (3, 3, "create", at(2), 4), (3, 3, "claim", at(3), 5)],
        [(3, 3, "complete", at(50), 6), (3, 3, "decline", at(51), 7), (4, 4, "create", at(59), 8)],
        [(5, 5, "create", at(61), 9)],  # request 1 has been idle for sixty minutes, and is not yet gone
        [(5, 5, "claim", at(70), 10)],  # now it is
        [(1, 1, "claim", at(71), 11), (4, 4, "decline", at(72), 12)],
    ]
    for k, rows in enumerate(batches):
        arrive(spark, tmp_path / "in", rows, EVENTS, k)
    got = {r.request: (r.status, r.updated_at, r.refused, r.expired) for r in last(spark, lifecycle.requests(events(spark, tmp_path / "in", "request", "action"), 60), tmp_path, ["request"])}
    assert got == {1: (None, None, 1, False), 2: (None, None, 1, False), 3: ("done", at(50), 1, False), 4: ("declined", at(72), 0, False), 5: ("claimed", at(70), 0, False)}
    # the checkpoint knows what was read: running again changes nothing, a later file goes on from the state
    arrive(spark, tmp_path / "in", [(5, 5, "complete", at(75), 13), (9, 9, "create", at(500), 14)], EVENTS, 9)
    got = {r.request: (r.status, r.expired) for r in last(spark, lifecycle.requests(events(spark, tmp_path / "in", "request", "action"), 60), tmp_path, ["request"])}
    assert got[5] == ("done", True) and got[3] == ("done", True) and got[9] == ("pending", False)


def test_jobs_expire(spark, tmp_path):
    batches = [[(1, 0, "start", at(0), 1), (1, 0, "done", at(5), 2), (1, 0, "step", at(6), 3), (2, 0, "start", at(1), 4)], [(2, 0, "step", at(20), 5), (3, 0, "start", at(33), 6)], [(4, 0, "start", at(34), 7)]]
    for k, rows in enumerate(batches):
        arrive(spark, tmp_path / "in", rows, EVENTS, k)
    e = events(spark, tmp_path / "in", F.col("key").alias("job"), F.col("action").alias("state"))
    got = {r.job: (r.since, r.status, r.expired) for r in last(spark, lifecycle.jobs(e, 30), tmp_path, ["job"])}
    assert got == {1: (at(5), "done", False), 2: (at(1), "running", True), 3: (at(33), "running", False), 4: (at(34), "running", False)}


def test_queue_admits_a_few(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), rng.randint(1, 12), rng.choice(["create", "create", "claim", "complete", "decline"]), at(4 * k), k) for k in range(300)]
    for k in range(0, 300, 60):
        arrive(spark, tmp_path / "in", rows[k : k + 60], EVENTS, k)
    out = lifecycle.admitted(events(spark, tmp_path / "in", F.col("key").alias("queue"), "request", "action"), 90, 2)
    results.stream_to(out, results.keeping(str(tmp_path / "out")), str(tmp_path / "check"), "update")
    got = [(r.queue, r.request, r.status, r.created_at, r.updated_at, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch", "_place").collect()]
    want, kept = [], {1: {}, 2: {}, 3: {}}
    for q, r, action, t, _ in rows:
        mine = kept[q]
        for k in [k for k, v in mine.items() if v[2] + dt.timedelta(minutes=90) < t]:
            want.append((q, k, *mine.pop(k), "expired"))
        if action == "create" and r not in mine:
            if sum(v[0] == "pending" for v in mine.values()) >= 2:
                want.append((q, r, "refused", t, t, "2 captures are already waiting"))
            else:
                mine[r] = ("pending", t, t)
                want.append((q, r, *mine[r], None))
        elif action != "create" and r in mine and mine[r][0] in ("pending", "claimed"):
            mine[r] = (lifecycle.STATUS[action], mine[r][1], t)
            want.append((q, r, *mine[r], None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(w[2] == "refused" for w in want) and any(w[5] == "expired" for w in want)


def test_result_files(spark, tmp_path):
    path = str(tmp_path / "results")
    table = lambda rows: spark.createDataFrame(rows, "id string, options string, result string")
    results.save(table([("a-1", "{}", '{"x":1}'), ("../etc", "{}", "{}"), ("b_2", None, '{"y":"ü\\n"}'), ("c", "{}", None), ("x" * 82, "{}", "{}")]), path, 0)
    results.save(table([("a-1", "{}", '{"x":2}')]), path, 1)
    results.save(table([("a-1", "{}", '{"x":2}')]), path, 1)  # the same batch again
    with open(tmp_path / "results" / "batch=1" / "broken.json", "w") as f:
        f.write('{"id":"d","result":"{}"\n{"id":"../e","result":"{}"}\n\n[]')
    got = {r.id: (r.options, r.result) for r in results.loaded(spark, path).collect()}
    assert got == {"a-1": ("{}", '{"x":2}'), "b_2": (None, '{"y":"ü\\n"}')}
    assert [json.loads(v)["x" if k == "a-1" else "y"] for k, (_, v) in sorted(got.items())] == [2, "ü\n"]
    reasons = sorted(r.reason for r in results.scanned(spark, path).where("reason is not null").collect())
    assert reasons.count("no result") == 1 and "no id" in reasons and "not JSON" in reasons
    # batch 0 grows old
    for f in (tmp_path / "results" / "batch=0").iterdir():
        os.utime(f, (1000, 1000))
    cutoff = dt.datetime.now() - dt.timedelta(hours=1)
    assert [r.id for r in results.expired(spark, path, cutoff).collect()] == ["b_2"]
    assert results.sweep(spark, path, cutoff) >= 1 and results.sweep(spark, path, cutoff) == 0
    assert [r.id for r in results.loaded(spark, path).collect()] == ["a-1"]


def test_stream_of_results_restarts_without_doubles(spark, tmp_path):
    schema = "id string, options string, result string"
    arrive(spark, tmp_path / "in", [("a", "{}", "{}"), ("b", "{}", '"1"')], schema, 0)
    arrive(spark, tmp_path / "in", [("b", "{}", '"2"')], schema, 1)
    read = lambda: lifecycle.source(spark, str(tmp_path / "in"), schema, 1)
    failed = []

    def breaks(df, batch):
        results.save(df, str(tmp_path / "files"), batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        results.stream_to(read(), breaks, str(tmp_path / "check"))
    results.stream_to(read(), breaks, str(tmp_path / "check"))
    assert {r.id: r.result for r in results.loaded(spark, str(tmp_path / "files")).collect()} == {"a": "{}", "b": '"2"'}
    assert results.scanned(spark, str(tmp_path / "files")).count() == 3


def test_jobs_find_results_in_late_files(spark, tmp_path):
    asked, stored = "job string, asked_at timestamp", "of string, stored_at timestamp, result string"
    arrive(spark, tmp_path / "asked", [("early", at(10)), ("late", at(12)), ("never", at(12)), ("old", at(40))], asked, 0)
    arrive(spark, tmp_path / "stored", [("early", at(1), "r1"), ("old", at(2), "gone")], stored, 0)
    arrive(spark, tmp_path / "stored", [("late", at(14), "r2"), ("other", at(41), "r3")], stored, 1)
    arrive(spark, tmp_path / "asked", [("end", at(200))], asked, 1)
    arrive(spark, tmp_path / "stored", [("end", at(200), "r4"), ("end", at(300), "too late")], stored, 2)
    arrive(spark, tmp_path / "asked", [("close", at(400))], asked, 2)
    arrive(spark, tmp_path / "stored", [("close", at(400), "r5")], stored, 3)
    a = lifecycle.source(spark, str(tmp_path / "asked"), asked, 1).withWatermark("asked_at", "5 minutes")
    s = lifecycle.source(spark, str(tmp_path / "stored"), stored, 1).withWatermark("stored_at", "5 minutes")
    results.stream_to(lifecycle.restored(a, s, "30 minutes", "10 minutes"), results.keeping(str(tmp_path / "out")), str(tmp_path / "check"))
    got = sorted(((r.job, r.result) for r in spark.read.parquet(str(tmp_path / "out")).where("job <> 'close'").collect()), key=repr)
    assert got == sorted([("early", "r1"), ("end", "r4"), ("late", "r2"), ("never", None), ("old", None)], key=repr)


def test_results_do_not_depend_on_files_and_batches(spark, tmp_path):
    path = str(tmp_path / "results")
    table = lambda *rows: spark.createDataFrame(rows, "id string, options string, result string").coalesce(1)
    results.save(table(("a", "3", "x"), ("b", "1", "x"), ("c", None, "y")), path, 0)
    results.save(table(("a", "2", "x"), ("b", "2", "x"), ("c", None, "x")), path, 1)
    # a second file of batch 0, which ended later
    results.save(table(("a", "1", "x"), ("d", "1", "z")), str(tmp_path / "more"), 0)
    file = next((tmp_path / "more" / "batch=0").glob("*.json.gz"))
    file.rename(tmp_path / "results" / "batch=0" / "late.json.gz")
    os.utime(tmp_path / "results" / "batch=0" / "late.json.gz", (4_000_000_000, 4_000_000_000))
    read = lambda *order: {r.id: (r.options, r.result) for r in results.loaded(spark, path, *order).collect()}
    assert read() == {"a": ("2", "x"), "b": ("2", "x"), "c": (None, "x"), "d": ("1", "z")}
    assert read(()) == {"a": ("3", "x"), "b": ("2", "x"), "c": (None, "y"), "d": ("1", "z")}
    results.save(table(("b", "0", "x")), path, 1)
    assert read()["a"] == ("3", "x")
