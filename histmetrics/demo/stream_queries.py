"""Streams run to their end over the driver's event table, and their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from histmetrics.demo import frames
from histmetrics.demo.registry import query
from histmetrics.session import scratch_path
from histmetrics.sources.store import HistoryStore
from histmetrics.streaming import incremental, progress, runs

FILES = 8  # of a batch of arrivals
TYPES = (progress.COMPLETED, progress.FAILED)


def event_stream(spark, sf):
    schema = frames.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drained(spark, stream, label, mode="append"):
    """All output of a stream over the data present now, as a static DataFrame."""
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(out)


@query("read_progress", "SELECT type, run_id, commits_total, processed FROM x_progress")
def _(spark, sf):
    path = scratch_path(spark, "events")
    events = frames.progress_events(frames.table(spark, sf, "events"))
    events.drop("seq", "arrived_at").write.json(path)
    rows = drained(spark, progress.read_progress(spark, path), "progress")
    return rows.select("type", "run_id", "commits_total", "processed")


@query("select_events", "SELECT seq, type, run_id FROM x_progress WHERE type IN ('run_completed', 'run_failed')")
def _(spark, sf):
    chosen = progress.select_events(frames.progress_events(event_stream(spark, sf)), TYPES)
    return drained(spark, chosen, "selected").select("seq", "type", "run_id")


_STATUS = """SELECT run_id, total, processed, CASE WHEN f THEN 'failed' WHEN c THEN 'completed'
    WHEN s OR processed > 0 THEN 'running' ELSE 'not_started' END AS state,
    CASE WHEN total > 0 THEN processed / total * 100.0::DOUBLE END AS percent FROM (SELECT run_id, max(commits_total) AS total,
    coalesce(max(processed), 0) AS processed, bool_or(type = 'run_started') AS s, bool_or(type = 'run_completed') AS c,
    bool_or(type = 'run_failed') AS f FROM x_progress GROUP BY ALL)"""


@query("run_status", _STATUS)
def _(spark, sf):
    return progress.run_status(frames.progress_events(frames.table(spark, sf, "events")))


def run_arrivals(spark, sf):
    """The event table as a stream that arrives out of order and in part twice, in four sets of files and a last tick.

    The tick belongs to no run; it moves the watermark past every timer.
    """
    folder = scratch_path(spark, "arrivals")
    events = frames.progress_events(frames.table(spark, sf, "events"))
    late = F.unix_timestamp("arrived_at") + F.pmod(F.xxhash64("seq"), F.lit(36_000))
    again = events.where(F.xxhash64("seq", F.lit(1)) % 20 == 0)
    sent = events.withColumn("_at", late).unionByName(again.withColumn("_at", late + 3600))
    bounds = sent.agg(F.percentile_approx("_at", [0.25, 0.5, 0.75]).alias("b")).first()["b"]
    numbers = sum((F.col("_at") > b).cast("int") for b in bounds)
    sent, parts = sent.withColumn("_file", numbers).drop("_at"), scratch_path(spark, "parts")
    sent.write.partitionBy("_file").parquet(parts)
    schema = sent.drop("_file").schema
    for k in range(4):
        # A batch is one part's files; a task reads no other part's rows.
        spark.read.schema(schema).parquet(f"{parts}/_file={k}").repartition(FILES).write.mode("append").parquet(folder)
    sent = spark.read.schema(schema).parquet(*[f"{parts}/_file={k}" for k in range(4)])
    ends = sent.agg(F.max("arrived_at").alias("t")).select((F.col("t") + F.expr("INTERVAL 4000 DAYS")).alias("arrived_at"))
    tick = ends.select(*[(F.col(f.name) if f.name == "arrived_at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    tick.withColumn("run_id", F.lit("tick")).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def closed_runs(spark, events):
    """Every run once, as the stream says when it drops the run's state. Runs of the table are silent for years."""
    watched = runs.watch_runs(events, "2 days", dt.timedelta(days=2000), dt.timedelta(days=2000))
    return drained(spark, watched, "runs", "update").where("closed")


@query("run_status_stream", _STATUS)
def _(spark, sf):
    return closed_runs(spark, run_arrivals(spark, sf)).select("run_id", "total", "processed", "state", "percent")


_CHECKS = """SELECT *, starts_first AND numbered AND constant_total AND one_terminal AND ends_last AS valid FROM (
       SELECT run_id, count(*) FILTER (type = 'commit_progress') AS progress_events,
       min_by(type, seq) = 'run_started' AND count(*) FILTER (type = 'run_started') = 1 AS starts_first,
       count(*) FILTER (type = 'commit_progress') = 0 OR (min(processed) = 1 AND max(processed) = count(*) FILTER (type = 'commit_progress')
         AND count(DISTINCT processed) = count(*) FILTER (type = 'commit_progress')) AS numbered,
       count(*) FILTER (type = 'commit_progress') = 0 OR (
         min(commits_total) FILTER (type = 'commit_progress') IS NOT DISTINCT FROM max(commits_total) FILTER (type = 'run_started')
         AND max(commits_total) FILTER (type = 'commit_progress') IS NOT DISTINCT FROM max(commits_total) FILTER (type = 'run_started')) AS constant_total,
       count(*) FILTER (type IN ('run_completed', 'run_failed')) = 1 AS one_terminal,
       coalesce(min(seq) FILTER (type IN ('run_completed', 'run_failed')) > max(seq) FILTER (type = 'commit_progress'),
         count(*) FILTER (type IN ('run_completed', 'run_failed')) > 0) AS ends_last
       FROM (SELECT * REPLACE (run_id || '-' || CAST(seq % 997 AS VARCHAR) AS run_id) FROM x_progress) GROUP BY ALL)"""


@query("check_progress", _CHECKS)
def _(spark, sf):
    events = frames.progress_events(frames.table(spark, sf, "events"))
    runs = F.concat_ws("-", "run_id", (F.col("seq") % 997).cast("string"))
    return progress.check_progress(events.withColumn("run_id", runs))


@query("check_progress_stream", _CHECKS.replace("% 997", "% 7"))
def _(spark, sf):
    events = run_arrivals(spark, sf)
    named = F.concat_ws("-", "run_id", (F.col("seq") % 7).cast("string"))
    closed = closed_runs(spark, events.withColumn("run_id", F.when(F.col("run_id") != "tick", named).otherwise("tick")))
    return closed.select(
        "run_id", "progress_events", "starts_first", "numbered", "constant_total", "one_terminal", "ends_last", "valid"
    )


@query("incremental_analyze", "SELECT version_id, source, target, score FROM x_edge")
def _(spark, sf):
    store = HistoryStore(spark, scratch_path(spark, "store"), versions_per_bucket=8)
    arrivals = scratch_path(spark, "arrivals")
    versions, edges = frames.versions(spark, sf), frames.edges(spark, sf)
    early = versions.where("version_order <= 7990")
    early.write.mode("append").parquet(arrivals)
    versions.where("version_order > 7984").write.mode("append").parquet(arrivals)
    nothing = frames.table(spark, sf, "region").where("false").select(
        F.col("r_name").alias("version_id"), F.col("r_name").alias("file_path"), F.col("r_name").alias("error_text")
    )

    def measure(wanted):
        return {"coupling_edge": edges.join(wanted.select("version_id"), "version_id", "left_semi")}, nothing

    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    state = scratch_path(spark, "arrivals-state")
    incremental.incremental_analyze(stream, store, measure, state).awaitTermination()
    return store.read("coupling_edge").select("version_id", "source", "target", F.col("score").cast("long").alias("score"))
