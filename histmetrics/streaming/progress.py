"""Progress events of analysis runs, as streams.

Every function works on a streaming and on a static DataFrame alike, so each
stream has a batch twin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histmetrics import schemas

# Event tags and run states.
STARTED, PROGRESS, COMPLETED, FAILED = "run_started", "commit_progress", "run_completed", "run_failed"
TYPES = (STARTED, PROGRESS, COMPLETED, FAILED)
TERMINAL = (COMPLETED, FAILED)


def read_progress(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of JSON lines, one file per run; lines with an unknown tag are left out.

    Progress events carry no run id: they take the name of their file.
    """
    events = (
        spark.readStream.schema(schemas.PROGRESS_EVENT)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    by_file = F.regexp_replace(F.col("_metadata.file_name"), "[.][^.]*$", "")
    return select_events(events.withColumn("run_id", F.coalesce("run_id", by_file)), TYPES)


def select_events(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """Events of some types; none chosen means all."""
    return events.where(F.col("type").isin(*types)) if types else events


def run_status(events: DataFrame, idle: str | None = None, arrived: str = "arrived_at") -> DataFrame:
    """State and percentage per run.

    State is ``failed`` or ``completed`` once a terminal event was seen, else
    ``running``, or ``not_started`` without any start. Percentage is NULL while
    the total is unknown or zero. State held is one small row per run; with
    ``idle`` (such as ``"2 hours"``) a run that has been silent for that long by
    its arrival times is closed and forgotten. Streams that run on are watched by
    :func:`histmetrics.streaming.runs.watch_runs`, which ends a run's state.
    """
    keys = [F.col("run_id")]
    if idle is not None:
        events = events.withWatermark(arrived, idle)
        keys.append(F.session_window(arrived, idle).alias("session"))

    def seen(kind: str):
        return F.coalesce(F.bool_or(F.col("type") == kind), F.lit(False))

    sums = events.groupBy(*keys).agg(
        F.max("commits_total").alias("total"),
        F.coalesce(F.max("processed"), F.lit(0)).alias("processed"),
        seen(STARTED).alias("_started"),
        seen(COMPLETED).alias("_completed"),
        seen(FAILED).alias("_failed"),
    )
    state = (
        F.when(F.col("_failed"), "failed")
        .when(F.col("_completed"), "completed")
        .when(F.col("_started") | (F.col("processed") > 0), "running")
        .otherwise("not_started")
    )
    percent = F.when(F.col("total") > 0, F.col("processed") / F.col("total") * 100.0)
    return sums.withColumn("state", state).withColumn("percent", percent).drop("_started", "_completed", "_failed")


def check_progress(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Whether each run's events form a valid sequence, one flag per rule.

    A run starts once and first, numbers its progress 1..n with one constant
    total, and ends with exactly one terminal event after all progress.
    """
    kind, at = F.col("type"), F.col(seq)
    progress, terminal = kind == PROGRESS, kind.isin(*TERMINAL)
    # Repeated numbers are counted away first, so no set of numbers is built up.
    numbers = (
        events.where(progress).groupBy("run_id", "processed").agg(F.count(F.lit(1)).alias("times"))
        .groupBy("run_id").agg(
            F.sum("times").alias("progress_events"),
            F.count("processed").alias("distinct_numbers"),
            F.min("processed").alias("lowest"),
            F.max("processed").alias("highest"),
        )
    )
    totals = events.groupBy("run_id").agg(
        F.min_by("type", at).alias("first_type"),
        F.count_if(kind == STARTED).alias("starts"),
        F.count_if(terminal).alias("terminals"),
        F.max(F.when(progress, at)).alias("last_progress"),
        F.min(F.when(terminal, at)).alias("first_terminal"),
        F.min(F.when(progress, F.col("commits_total"))).alias("least_total"),
        F.max(F.when(kind == STARTED, F.col("commits_total"))).alias("started_total"),
        F.max(F.when(progress, F.col("commits_total"))).alias("greatest_total"),
    )
    n = F.coalesce("progress_events", F.lit(0))
    checks = totals.join(numbers, "run_id", "left").select(
        "run_id",
        n.cast("long").alias("progress_events"),
        ((F.col("first_type") == STARTED) & (F.col("starts") == 1)).alias("starts_first"),
        (
            (n == 0)
            | ((F.col("lowest") == 1) & (F.col("highest") == n) & (F.col("distinct_numbers") == n))
        ).alias("numbered"),
        (
            (n == 0)
            | (
                F.col("least_total").eqNullSafe(F.col("started_total"))
                & F.col("greatest_total").eqNullSafe(F.col("started_total"))
            )
        ).alias("constant_total"),
        (F.col("terminals") == 1).alias("one_terminal"),
        F.coalesce(F.col("first_terminal") > F.col("last_progress"), F.col("terminals") > 0).alias("ends_last"),
    )
    valid = F.col("starts_first") & F.col("numbered") & F.col("constant_total") & F.col("one_terminal") & F.col("ends_last")
    return checks.withColumn("valid", valid)
