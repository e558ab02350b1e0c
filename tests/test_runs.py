"""Runs as a stream: equal to the batch twin on shuffled, late and repeated events; state ends."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from histmetrics.session import scratch_path
from histmetrics.streaming import runs
from histmetrics.streaming.progress import COMPLETED, FAILED, PROGRESS, STARTED

SCHEMA = "run_id string, type string, seq long, commits_total int, processed int, arrived_at timestamp"
START = dt.datetime(2024, 1, 1)


def test_ranges_hold_any_order_of_numbers():
    rng = random.Random(1)
    for _ in range(200):
        numbers, ranges = [rng.randint(-3, 12) for _ in range(rng.randint(0, 15))], []
        new = [runs.add_number(ranges, n) for n in numbers]
        assert sum(new) == len(set(numbers))
        held = [n for a, b in zip(ranges[::2], ranges[1::2]) for n in range(a, b + 1)]
        assert held == sorted(set(numbers)) and all(b + 1 < a for b, a in zip(ranges[1::2], ranges[2::2]))


def events():
    rows = []

    def run(name, kinds, at, total=3, numbers=None):
        number = iter(numbers or range(1, 100))
        for k, kind in enumerate(kinds):
            rows.append((name, kind, k, total if kind != FAILED else None, next(number) if kind == PROGRESS else None, START + dt.timedelta(minutes=at + k)))

    for i in range(12):
        run(f"good{i}", [STARTED, *[PROGRESS] * 3, COMPLETED], 7 * i)
    run("failed", [STARTED, PROGRESS, FAILED], 5)
    run("gap", [STARTED, *[PROGRESS] * 3, COMPLETED], 20, numbers=[1, 3, 4])
    run("again", [STARTED, *[PROGRESS] * 3, COMPLETED], 22, numbers=[1, 2, 2])
    run("late start", [PROGRESS, STARTED, PROGRESS, COMPLETED], 24)
    run("open", [STARTED, PROGRESS], 30)
    run("two ends", [STARTED, PROGRESS, COMPLETED, FAILED], 31)
    run("after end", [STARTED, COMPLETED, PROGRESS], 33)
    run("only end", [COMPLETED], 40)
    run("other total", [STARTED, PROGRESS, PROGRESS, COMPLETED], 41)
    rows[-2] = (*rows[-2][:3], 9, *rows[-2][4:])
    rows.append(("no type", None, 0, None, None, START))
    rows.append((None, STARTED, 0, 1, None, START))
    return rows


def test_stream_equals_batch_and_state_falls_to_zero(spark):
    rows, rng = events(), random.Random(2)
    sent = [*rows, *rng.sample(rows, 30)]  # repeated events
    # Up to ten minutes out of order, in files of 15 events.
    sent.sort(key=lambda r: r[5] + dt.timedelta(minutes=10 * rng.random()))
    folder, out = scratch_path(spark, "arrivals"), scratch_path(spark, "out")
    for k in range(0, len(sent), 15):
        spark.createDataFrame(sent[k : k + 15], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    # A later event that no run holds moves the watermark past all timers.
    spark.createDataFrame([(None, None, 0, None, None, START + dt.timedelta(days=9))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    tick = stream.withColumn("run_id", F.coalesce("run_id", F.lit("tick")))
    watched = runs.watch_runs(tick, "15 minutes", dt.timedelta(hours=2), dt.timedelta(hours=1))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    def drain():
        query = watched.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-state")
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    drain()
    spark.createDataFrame([("tick", None, 1, None, None, START + dt.timedelta(days=99))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    state = drain().recentProgress[-1]["stateOperators"]
    known = [r for r in spark.read.parquet(out).drop("batch").collect() if r["run_id"] != "tick"]
    closed = {r["run_id"]: tuple(r)[:-1] for r in known if r["closed"]}
    batch = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    names = [c.split()[0] for c in runs.OUT.split(", ")][:-1]
    want = {r["run_id"]: tuple(r) for r in runs.judge_runs(batch).select(*names).collect()}
    assert closed == want and len([r for r in known if r["closed"]]) == len(want)
    assert sum(v[-1] for v in want.values()) == 13  # the good ones and the failed one
    assert sum(op["numRowsTotal"] for op in state) <= 2  # the last tick: its state and its mark against repeats


def test_a_batch_sends_few_messages_and_a_timer_that_rings_early_is_set_again():
    """Only what changes is said to the JVM: a later event of a run moves no timer."""

    class Handle:
        def __init__(self):
            self.said, self.held = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.held

        def update(self, row):
            self.said.append("update")
            self.held = row

        def clear(self):
            self.held = None

        def registerTimer(self, at):
            self.said.append(("register", at))

        def deleteTimer(self, at):
            self.said.append(("delete", at))

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    def batch(kind, at):
        handle.said = []
        rows = [{"type": kind, "seq": at, "commits_total": 3, "processed": None, "at_ms": at}]
        return [r["closed"] for r in watcher.handleInputRows(("r",), iter(rows), None)]

    handle, watcher = Handle(), runs.RunWatcher(1000, 10)
    watcher.init(handle)
    assert batch(STARTED, 0) == [False] and handle.said == [("register", 1000), "update"]
    assert batch(PROGRESS, 500) == [False] and handle.said == ["update"]
    handle.said = []
    assert list(watcher.handleExpiredTimer(("r",), Clock(1200), None)) == [] and handle.said == [("register", 1500), "update"]
    assert batch(COMPLETED, 600) == [False] and handle.said == [("delete", 1500), ("register", 610), "update"]
    assert [r["closed"] for r in watcher.handleExpiredTimer(("r",), Clock(700), None)] == [True] and handle.held is None


def test_runs_of_a_group_share_their_messages():
    """A batch of a hundred runs says as little as one of a single run; each run is closed when it is due."""

    class Handle:
        def __init__(self):
            self.said, self.held = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.said.append("get")
            return self.held

        def update(self, row):
            self.said.append("update")
            self.held = row

        def clear(self):
            self.held = None

        def registerTimer(self, at):
            self.said.append(("register", at))

        def deleteTimer(self, at):
            self.said.append(("delete", at))

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    def batch(kind, at, names):
        handle.said = []
        code = {name: code for code, name in runs.CODES.items()}[kind]
        sent = [{"event": f"{code},{at},3,,{at},{name}"} for name in names]
        return sorted((r[0], r[-1]) for r in told(watcher.handleInputRows((0,), iter(sent), None)))

    def told(rows):
        return [json.loads(r["told"]) for r in rows]

    def ring(now):
        handle.said = []
        return sorted((r[0], r[3]) for r in told(watcher.handleExpiredTimer((0,), Clock(now), None)))

    names = sorted(f"r,{k}" for k in range(100))
    handle, watcher = Handle(), runs.GroupWatcher(1000, 10)
    watcher.init(handle)
    assert batch(STARTED, 0, names) == [(n, False) for n in names] and handle.said == ["get", ("register", 1000), "update"]
    assert batch(PROGRESS, 500, names[1:]) == [(n, False) for n in names[1:]] and handle.said == ["get", "update"]
    assert batch(COMPLETED, 600, names[-1:]) == [(names[-1], False)] and handle.said == ["get", ("delete", 1000), ("register", 610), "update"]
    assert ring(700) == [(names[-1], "completed")] and handle.said == ["get", ("register", 1000), "update"]
    assert ring(1000) == [(names[0], "running")] and handle.said == ["get", ("register", 1500), "update"]
    assert ring(2000) == [(n, "running") for n in names[1:-1]] and handle.held is None
