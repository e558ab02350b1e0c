"""Incremental analysis: new versions only, measured as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from histmetrics import schemas
from histmetrics.extract.complexity import apply_error_policy
from histmetrics.operators.measures import run_outcome
from histmetrics.session import stored
from histmetrics.sources.logs import pending_versions
from histmetrics.sources.store import HistoryStore

Measure = Callable[[DataFrame], tuple[dict[str, DataFrame], DataFrame]]


def _reason(error: Exception) -> str:
    """The last line that says something."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip() and not line.strip().startswith("at ")]
    return f"{type(error).__name__}: {lines[0] if lines else ''}"[:500]


def stage_apart(
    store: HistoryStore, versions: DataFrame, measure: Measure, run_id: str | None = None, fail_fast: bool = False
) -> tuple[list[str], set[str]]:
    """Measure versions and stage their rows; a version that cannot be measured fails alone.

    All versions are one job. Only if it fails are they halved, by their order, until
    the versions that fail by themselves are found: each becomes a failure row, and the
    others are staged. A run with few such versions costs a few jobs for each of them.
    Returns the staged generations and the names of the tables that were measured.
    """
    try:
        tables, failures = measure(versions)
        if run_id is not None and failures is not None:
            failures = failures.withColumn("run_id", F.lit(run_id))
        return [store.stage(versions, tables, failures)], set(tables)
    except Exception as error:
        if fail_fast:
            raise
        found = versions.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("version_order", 0.5).alias("mid")).first()
        if found["n"] < 2:
            failed = versions.select(
                F.lit(run_id).cast("string").alias("run_id"), "version_id",
                F.lit(None).cast("string").alias("file_path"), F.lit(_reason(error)).alias("error_text"),
            )
            return [store.stage(versions, {}, failed)], set()
    generations: list[str] = []
    names: set[str] = set()
    early = F.col("version_order") <= found["mid"]
    if versions.where(~early).isEmpty():
        early = F.col("version_order") < found["mid"]
    for half in (versions.where(early), versions.where(~early)):
        made, tables = stage_apart(store, half, measure, run_id, fail_fast)
        generations, names = [*generations, *made], names | tables
    return generations, names


def outcome(store: HistoryStore, versions: DataFrame, tables: Sequence[str], generations: Sequence[str], run_id: str) -> dict[str, int]:
    """How many versions of a run succeeded and failed, from its staged rows."""
    none = store.spark.createDataFrame([], "version_id string")
    measured = none
    for table in tables:
        measured = measured.unionByName(store.staged(table, generations).select("version_id"))
    failed = store.staged("failure", generations).groupBy("version_id").agg(F.count(F.lit(1)).alias("failures"))
    flags = (
        versions.select("version_id")
        .join(measured.distinct().withColumn("has_metrics", F.lit(True)), "version_id", "left")
        .join(failed, "version_id", "left")
        .select(
            F.lit(run_id).alias("run_id"),
            F.coalesce("has_metrics", F.lit(False)).alias("has_metrics"),
            F.coalesce("failures", F.lit(0)).alias("failures"),
        )
    )
    row = run_outcome(flags).first()
    return {"versions_succeeded": row["succeeded"] if row else 0, "versions_failed": row["failed"] if row else 0}


def analyze_pending(
    store: HistoryStore,
    planned: DataFrame,
    measure: Measure,
    rebuild: bool = False,
    project: DataFrame | None = None,
    run_id: str | None = None,
    branch: str | None = None,
    unreadable: DataFrame | None = None,
    fail_fast: bool = False,
    batch: tuple[str, int] | None = None,
) -> None:
    """Measure planned versions the store lacks (all of them on a rebuild) and store them.

    ``measure`` maps versions to their rows by table, and the failures. Without a
    rebuild, a store of another schema version or scope is refused before anything
    is measured. ``unreadable`` (version_id, error_text) names versions that could not
    be read at all: they are not measured and become failures, as do versions whose
    measuring fails (see :func:`stage_apart`); with ``fail_fast`` either ends the run.
    The run has an entry in the ledger from its start to its end, with its tally; rows,
    failures, project and the batch number become visible together.
    """
    if not rebuild:
        store.check(project)
    if store.has_batch(batch):
        return
    run_id = run_id or uuid.uuid4().hex
    wanted = planned if rebuild or not store.exists("version") else pending_versions(planned, store.read("version"))
    todo = stored(wanted, "pending")  # with its size known, files meet it without a shuffle
    store.start_run(
        run_id, branch=branch, mode="rebuild" if rebuild else "incremental", versions_total=F.lit(todo.count()).cast("int")
    )
    try:
        good, generations = todo, []
        if unreadable is not None:
            judged = apply_error_policy(unreadable, todo, fail_fast)
            bad = judged.where("failed").select(
                F.lit(run_id).alias("run_id"), "version_id", F.lit(None).cast("string").alias("file_path"), "error_text"
            )
            good = judged.where("NOT failed").select(*todo.columns)
            generations.append(store.stage(todo, {}, bad))
        made, names = stage_apart(store, good, measure, run_id, fail_fast)
        generations += made
        tally = outcome(store, todo, sorted(names), generations, run_id)
        store.store(todo, sorted(names), generations, rebuild, batch, project, run_id)
    except BaseException:
        store.finish_run(run_id, "failed")
        raise
    store.finish_run(run_id, "completed", **{k: int(v) for k, v in tally.items()})


def incremental_analyze(
    arrivals: DataFrame,
    store: HistoryStore,
    measure: Measure,
    checkpoint: str,
    once: bool = True,
    rebuild: bool = False,
    project: DataFrame | None = None,
) -> StreamingQuery:
    """Run :func:`analyze_pending` for every batch of arriving version rows.

    The number of the stream's batch is stored with its rows, in the same switch, so a
    batch that comes again after a failure is recognised: nothing is measured twice and
    no failure is doubled. In full mode (``rebuild``) the first batch replaces the store
    and the later ones add to it. ``checkpoint`` names the stream, so a folder that was
    cleared must not be used again with the same store.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["version_id"])
        analyze_pending(store, rows, measure, rebuild and number == 0, project, batch=(checkpoint, number))

    writer = arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
