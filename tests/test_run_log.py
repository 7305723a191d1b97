"""The run log as a stream: restarts, order, timers and newer runs against one pass over the log."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tableops.operators.stored import StoredTable
from tableops.streaming.run_log import KEYS, follow_runs, followed_runs, run_table_schema
from tableops.streaming.streams import stream_files
from tableops.workdir import work_dir

LOG = "process string, run_id int, status string, at timestamp_ntz"
WAIT = timedelta(minutes=10)
DAY = datetime(2024, 1, 1)


def expected(log, last):
    """Brute force: each run by its rows, then those given up by `last` (a watermark), then those with a newer one running."""
    runs = {}
    for process, run, status, at in log:
        if at is not None and status is not None:
            runs.setdefault((process, run), []).append((at, status))
    found = {}
    for key, said in runs.items():
        at, status = max(said)
        ended = max((a for a, s in said if s != "RUNNING"), default=None)
        if status == "RUNNING" and at + WAIT < last:
            status, ended = "STALE", at + WAIT
        found[key] = [status, min(a for a, _ in said), ended]
    for process in {p for p, _ in found}:
        running = [r[1] for (p, _), r in found.items() if p == process and r[0] == "RUNNING"]
        for (p, _), r in found.items():
            if p == process and running and r[1] < max(running) and (r[0] == "RUNNING" or r[2] is None):
                r[0], r[2] = "STALE", max(running)
    return {(*key, *r) for key, r in found.items()}


def follow(spark, parts):
    """Each part is a file that comes after a stop of the stream."""
    src, state = work_dir(spark, "log"), work_dir(spark, "state")
    schema = spark.createDataFrame([], LOG).schema
    table = StoredTable(spark, work_dir(spark, "runs"), run_table_schema(schema), KEYS, buckets=4)
    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
        follow_runs(stream_files(spark, src, schema, "parquet"), table, WAIT, "30 minutes", state)
    return table, {tuple(r) for r in followed_runs(table, WAIT).collect()}


def minute(n):
    return DAY + timedelta(minutes=n, microseconds=n * 7 % 1000)


def test_restarts_and_order_change_nothing(spark):
    rng = random.Random(5)
    log = []
    for run in range(40):
        process, start = rng.choice(["a", "b", None]), rng.randint(0, 90)
        log.append((process, run, "RUNNING", minute(start)))
        if rng.random() < 0.3:  # heard of once more
            log.append((process, run, "RUNNING", minute(start + 8)))
        if rng.random() < 0.6:
            log.append((process, run, rng.choice(["SUCCESS", "FAIL"]), minute(start + rng.randint(0, 25))))
    log += [*log[:5], ("a", 3, None, minute(3)), ("a", 4, "FAIL", None)]
    last = max(at for *_, at in log if at is not None)
    log.sort(key=lambda row: ((row[3] or DAY) - DAY).total_seconds() + rng.uniform(0, 29 * 60))  # out of order, within the lateness
    cuts = [0, 30, 31, 60, len(log)]
    found = [follow(spark, [log[a:b] for a, b in zip(cuts, cuts[1:])]), follow(spark, [log])]
    want = expected(log, last - timedelta(minutes=30))
    assert {r[2] for r in want} == {"RUNNING", "SUCCESS", "FAIL", "STALE"}
    for _, rows in found:
        assert rows == want


def test_given_up_runs_can_end_later(spark):
    first = [("a", 1, "RUNNING", minute(0)), ("b", 2, "RUNNING", minute(100))]
    later = [("a", 1, "SUCCESS", minute(90))]
    table, rows = follow(spark, [first])
    assert ("a", 1, "STALE", minute(0), minute(0) + WAIT) in rows
    table, rows = follow(spark, [first, later])
    assert ("a", 1, "SUCCESS", minute(0), minute(90)) in rows
    assert table.read().where(F.col("run_id") == 1).select("timed_out").first()[0] == minute(0) + WAIT


def test_runs_are_given_up_to_the_microsecond(spark):
    """SQL compares whole times, so half a millisecond past the time-out counts."""
    log = [("a", 1, "RUNNING", DAY), ("b", 2, "RUNNING", DAY + timedelta(minutes=40, microseconds=500))]
    assert ("a", 1, "STALE", DAY, DAY + WAIT) in follow(spark, [log])[1]
    log[1] = ("b", 2, "RUNNING", DAY + timedelta(minutes=40))
    assert ("a", 1, "RUNNING", DAY, None) in follow(spark, [log])[1]


def test_silent_runs_outside_a_batch_and_late_rows(spark):
    first = [("a", k, "RUNNING", minute(0)) for k in range(40)]
    table, rows = follow(spark, [first, [("z", 99, "RUNNING", minute(100))], [("a", 0, "SUCCESS", minute(60)), ("a", 1, "FAIL", minute(71))]])
    assert sorted(r[1] for r in rows if r[2] == "STALE") == [0, *range(2, 40)]  # 60 is before the watermark, 70: too late
    assert ("a", 1, "FAIL", minute(0), minute(71)) in rows
    assert table.read().where("timed_out IS NULL").select("run_id").collect() == [(99,)]
    assert table.changes([1]).where("_change_type = 'update_postimage'").count() == 40


def test_empty_log(spark):
    assert follow(spark, [[]])[1] == set()
