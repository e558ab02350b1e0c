"""Runs judged while their events arrive: a keyed processor whose state ends with the run.

Runs share keys by a hash of their id, so a batch costs messages by groups of runs.
Per run the state is one small row, whatever the number of events: counts, extremes,
and the progress numbers seen as ranges, which are one range as long as none is
missing. Repeated events (same run and ``seq``) are left out before it, late ones within the
watermark's delay count wherever they belong, because nothing depends on the order of
arrival. A run is closed, and its state dropped, when the watermark has passed its
last event by ``grace`` after a terminal event, or by ``idle`` without one.
"""

from __future__ import annotations

import datetime as dt
import json
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from histmetrics.streaming.progress import COMPLETED, FAILED, PROGRESS, STARTED, TERMINAL, check_progress, run_status

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATUS = "total int, processed int, state string, percent double"
CHECKS = (
    "progress_events long, starts_first boolean, numbered boolean, constant_total boolean, one_terminal boolean, "
    "ends_last boolean, valid boolean"
)
OUT = f"run_id string, {STATUS}, {CHECKS}, closed boolean"
#: What is kept of a run. Ranges are flat pairs: first and last number of each.
STATE = T.StructType(
    [T.StructField(n, T.LongType()) for n in (
        "least_seq", "starts", "completed", "failed", "progress", "repeated", "last_progress", "first_terminal",
        "least_total", "greatest_total", "started_total", "total", "processed", "last_ms", "odd", "timer_ms",
    )]
    + [T.StructField("first_type", T.StringType()), T.StructField("ranges", T.ArrayType(T.LongType()))]
)

#: What is kept of a group of runs: when its timer rings, and its runs' names and states as JSON.
GROUP = T.StructType([T.StructField("timer_ms", T.LongType()), T.StructField("runs", T.StringType())])
GROUPS = 4096


def _less(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _more(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def add_number(ranges: list[int], number: int) -> bool:
    """Put a number into sorted flat ranges, in place; False if it is there already."""
    starts, ends = ranges[::2], ranges[1::2]
    at = bisect_right(starts, number)
    if at and ends[at - 1] >= number:
        return False
    left = at > 0 and ends[at - 1] == number - 1
    right = at < len(starts) and starts[at] == number + 1
    if left and right:
        del ranges[2 * at - 1 : 2 * at + 1]
    elif left:
        ranges[2 * at - 1] = number
    elif right:
        ranges[2 * at] = number
    else:
        ranges[2 * at : 2 * at] = [number, number]
    return True


class Run:
    """The state of one run as a mutable record."""

    def __init__(self, row: tuple | None):
        empty = dict.fromkeys(STATE.names)
        empty.update(dict.fromkeys(("starts", "completed", "failed", "progress", "repeated", "odd"), 0), ranges=[])
        self.s = dict(zip(STATE.names, row)) if row is not None else empty
        self.s["ranges"] = [int(x) for x in self.s["ranges"]]

    def add(self, kind: str | None, seq: int | None, total: int | None, processed: int | None, at_ms: int) -> None:
        s = self.s
        s["last_ms"] = _more(s["last_ms"], at_ms)
        s["total"], s["processed"] = _more(s["total"], total), _more(s["processed"], processed)
        if seq is not None and (s["least_seq"] is None or seq < s["least_seq"]):
            s["least_seq"], s["first_type"] = seq, kind
        if kind == STARTED:
            s["starts"] += 1
            s["started_total"] = _more(s["started_total"], total)
        elif kind in TERMINAL:
            s["completed" if kind == COMPLETED else "failed"] += 1
            s["first_terminal"] = _less(s["first_terminal"], seq)
        elif kind == PROGRESS:
            s["progress"] += 1
            s["last_progress"] = _more(s["last_progress"], seq)
            s["least_total"], s["greatest_total"] = _less(s["least_total"], total), _more(s["greatest_total"], total)
            # Events without a number share one, as a group of their own.
            new = add_number(s["ranges"], processed) if processed is not None else not s["odd"]
            s["odd"] = s["odd"] or int(processed is None)
            s["repeated"] += not new

    def ended(self) -> bool:
        return bool(self.s["completed"] or self.s["failed"])

    def row(self, run_id: str, closed: bool) -> tuple:
        s, n = self.s, self.s["progress"]
        done = s["processed"] or 0
        state = "failed" if s["failed"] else "completed" if s["completed"] else "running" if s["starts"] or done > 0 else "not_started"
        percent = done / s["total"] * 100.0 if s["total"] and s["total"] > 0 else None
        terminals = s["completed"] + s["failed"]
        starts_first = s["first_type"] == STARTED and s["starts"] == 1
        numbered = n == 0 or (not s["repeated"] and not s["odd"] and s["ranges"] == [1, n])
        constant = n == 0 or s["least_total"] == s["greatest_total"] == s["started_total"]
        ends_last = (
            s["first_terminal"] > s["last_progress"]
            if s["first_terminal"] is not None and s["last_progress"] is not None
            else terminals > 0
        )
        checks = (starts_first, numbered, constant, terminals == 1, ends_last)
        return (run_id, s["total"], done, state, percent, n, *checks, all(checks), closed)


OUT_ROW = Row(*(c.split()[0] for c in OUT.split(", ")))


class RunWatcher(StatefulProcessor):
    """One row per run and batch that touched it, and one when it is closed.

    Every call of the handle is a message to the JVM, so a run's timer is moved only when it
    must ring earlier; one that rings before the run is due is set again then.
    """

    def __init__(self, idle_ms: int, grace_ms: int):
        self.idle_ms, self.grace_ms = idle_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("run", STATE)

    def _due(self, run: Run) -> int:
        return run.s["last_ms"] + (self.grace_ms if run.ended() else self.idle_ms)

    def _keep(self, run: Run) -> None:
        self.kept.update(tuple(run.s[n] for n in STATE.names))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        run = Run(self.kept.get())
        for row in rows:
            run.add(row["type"], row["seq"], row["commits_total"], row["processed"], row["at_ms"])
        due, timer = self._due(run), run.s["timer_ms"]
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            run.s["timer_ms"] = due
        self._keep(run)
        yield OUT_ROW(*run.row(key[0], False))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        kept = self.kept.get()
        if kept is None:
            return
        run = Run(kept)
        due = self._due(run)
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            run.s["timer_ms"] = due
            self._keep(run)
            return
        self.kept.clear()
        yield OUT_ROW(*run.row(key[0], True))

    def close(self) -> None:
        pass


#: An event as one text, since each cell that goes to Python or back costs more than its value: a letter
#: for its type (none for others, which count as no type), numbers (empty where NULL), and the run's id last.
CODES = {"s": STARTED, "p": PROGRESS, "c": COMPLETED, "f": FAILED}
SAID = Row("told")


def _as_text() -> Column:
    kind = F.lit("")
    for code, name in CODES.items():
        kind = F.when(F.col("type") == name, code).otherwise(kind)
    numbers = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seq", "commits_total", "processed", "at_ms")]
    return F.concat_ws(",", kind, *numbers, "run_id")


def _told() -> list[Column]:
    """The columns of ``OUT`` from a row's JSON array."""
    names = [c.split(" ") for c in OUT.split(", ")]
    text = F.from_json("told", "array<string>")
    return [F.get(text, F.lit(k)).cast(kind).alias(name) for k, (name, kind) in enumerate(names)]


class GroupWatcher(StatefulProcessor):
    """:class:`RunWatcher` for many runs that share a key, a state row and a timer.

    The messages to the JVM follow the groups and not the runs. The state is a list of the
    runs' rows as JSON; the timer rings when the first of them may be due, and closes all
    that are.
    """

    def __init__(self, idle_ms: int, grace_ms: int):
        self.judge = RunWatcher(idle_ms, grace_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("runs", GROUP)

    def _load(self) -> tuple[int | None, dict[str, tuple]]:
        kept = self.kept.get()
        return (None, {}) if kept is None else (kept[0], {name: row for name, *row in json.loads(kept[1])})

    def _keep(self, timer: int, rows: dict[str, tuple]) -> None:
        self.kept.update((timer, json.dumps([(name, *row) for name, row in rows.items()], separators=(",", ":"))))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        timer, kept = self._load()
        touched: dict[str, Run] = {}
        for row in rows:
            kind, seq, total, processed, at_ms, run_id = row["event"].split(",", 5)
            run = touched.get(run_id)
            if run is None:
                run = touched[run_id] = Run(kept.get(run_id))
            numbers = [int(x) if x else None for x in (seq, total, processed)]
            run.add(CODES.get(kind), *numbers, int(at_ms))
        if not touched:
            return
        kept.update((name, tuple(run.s[n] for n in STATE.names)) for name, run in touched.items())
        due = min(self.judge._due(run) for run in touched.values())
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self._keep(timer, kept)
        for name, run in touched.items():
            yield SAID(json.dumps(run.row(name, False)))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        _, kept = self._load()
        now, closed, left = timerValues.getCurrentWatermarkInMs(), [], []
        for name, row in kept.items():
            run = Run(row)
            due = self.judge._due(run)
            if due > now:
                left.append(due)
            else:
                closed.append((name, run))
        for name, _ in closed:
            del kept[name]
        if kept:
            self.handle.registerTimer(min(left))
            self._keep(min(left), kept)
        else:
            self.kept.clear()
        for name, run in closed:
            yield SAID(json.dumps(run.row(name, True)))

    def close(self) -> None:
        pass


def watch_runs(
    events: DataFrame,
    delay: str = "10 minutes",
    idle: dt.timedelta = dt.timedelta(hours=2),
    grace: dt.timedelta = dt.timedelta(minutes=30),
    seq: str = "seq",
    arrived: str = "arrived_at",
    groups: int = GROUPS,
) -> DataFrame:
    """State, percentage and validity of each run of a stream, in update mode.

    Runs are kept in ``groups`` by a hash of their id; the number must stay what it was
    when the stream began.

    A row per run that a batch touched, with ``closed`` false, and one with ``closed``
    true when its state is dropped; the last row of a run equals
    :func:`judge_runs` over its events. Events without a time or a run are left out.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)  # keyed processors need it
    once = (
        events.where(F.col("run_id").isNotNull() & F.col(arrived).isNotNull())
        .select(
            "run_id", "type", F.col(seq).cast("long").alias("seq"), F.col("commits_total").cast("long").alias("commits_total"),
            F.col("processed").cast("long").alias("processed"), F.col(arrived).cast("timestamp").alias("arrived_at"),
            F.unix_millis(F.col(arrived).cast("timestamp")).alias("at_ms"),
        )
        .withWatermark("arrived_at", delay)
        .dropDuplicatesWithinWatermark(["run_id", "seq"])
    )
    ms = [int(span.total_seconds() * 1000) for span in (idle, grace)]
    grouped = once.select(F.pmod(F.xxhash64("run_id"), F.lit(groups)).alias("group"), _as_text().alias("event"))
    told = grouped.groupBy("group").transformWithState(GroupWatcher(*ms), "told string", "Update", "EventTime")
    return told.select(*_told())


def judge_runs(events: DataFrame, seq: str = "seq") -> DataFrame:
    """The batch twin of :func:`watch_runs`: what a stream says of each run once all its events have come."""
    once = events.where(F.col("run_id").isNotNull()).dropDuplicates(["run_id", seq])
    return run_status(once).join(check_progress(once, seq), "run_id")
