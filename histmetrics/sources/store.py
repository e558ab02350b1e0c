"""The history store: Parquet folders with insert-or-replace by key.

Large tables are partitioned by a bucket of the version order, never by single
versions. An upsert reads and rewrites only the buckets that new rows fall into, and
all tables change at once, by a snapshot that names the folders that count.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics import schemas
from histmetrics.session import cut_lineage, folder_names, remove_folder, stored
from histmetrics.sources.tables import MissingTable, assert_compatible, conform, read_table

BUCKET = "version_bucket"
VERSIONS_PER_BUCKET = 64
TOOL_VERSION = "0.3.0"
RUNS, FIRST = "analysis_run", "first"
HEAD, BATCH = "", "_batch"
#: A snapshot's rows: where each bucket lies; for a stream, its name and last batch number.
SNAPSHOT = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField(BUCKET, T.LongType()),
        T.StructField("generation", T.StringType()),
    ]
)


class ScopeConflict(ValueError):
    """An incremental run asks for another scope than the stored one."""


def newest(rows: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """One row per key: the one that is last in order."""
    cols = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*cols), F.col(order) if isinstance(order, str) else order)
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*")


def upsert_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert or replace: incoming rows win, other existing rows stay.

    ``incoming`` must hold a key once (see :func:`newest`).
    """
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def storable_versions(versions: DataFrame, failures: DataFrame, *measured: DataFrame) -> DataFrame:
    """Versions to record: all but those that brought failures and nothing else.

    A failure-only version stays unrecorded and is tried again next time.
    """
    ids = measured[0].select("version_id")
    for other in measured[1:]:
        ids = ids.unionByName(other.select("version_id"))
    failed = failures.select("version_id").distinct().join(ids.distinct(), "version_id", "left_anti")
    return versions.join(failed, "version_id", "left_anti")


@dataclass(frozen=True)
class Snapshot:
    """Which folder holds each bucket of each table, and the last batch of each stream that is in them."""

    number: int = 0
    folders: dict[tuple[str, int | None], str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def of(self, table: str) -> dict[int | None, str]:
        return {bucket: generation for (name, bucket), generation in self.folders.items() if name == table}


class HistoryStore:
    """Tables of one project under a root folder, for one writer and any number of readers.

    A write makes new folders (``<table>/generation=…/version_bucket=…``) and then
    appends one small file to ``snapshot``, which lists the folders that count from
    then on. That file is the only switch: until it is there readers see the old rows
    of all tables, from then on the new rows of all. An interrupted write leaves only
    folders that no snapshot names; :meth:`vacuum` removes them.
    """

    def __init__(
        self, spark: SparkSession, root: str, versions_per_bucket: int = VERSIONS_PER_BUCKET, at: Snapshot | None = None
    ) -> None:
        self.spark, self.root, self.versions_per_bucket = spark, root.rstrip("/"), versions_per_bucket
        self._at, self._known = at, Snapshot()

    # --- snapshots

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def snapshot(self) -> Snapshot:
        """The newest snapshot (number 0 if there is none), or the one that this reader is pinned to."""
        if self._at is not None:
            return self._at
        names = [n for n in folder_names(self.spark, self.path("snapshot")) if n.startswith("number=")]
        newest_number = max((int(n.split("=")[1]) for n in names), default=0)
        if newest_number != self._known.number:
            self._known = self._snapshot(newest_number)
        return self._known

    def _snapshot(self, number: int) -> Snapshot:
        if not number:
            return Snapshot()
        rows = self.spark.read.schema(SNAPSHOT).parquet(f"{self.path('snapshot')}/number={number}").collect()
        folders = {(r["table"], r[BUCKET]): r["generation"] for r in rows if r["table"] not in (HEAD, BATCH)}
        return Snapshot(number, folders, {r["generation"]: r[BUCKET] for r in rows if r["table"] == BATCH})

    def pinned(self) -> HistoryStore:
        """A reader that stays with today's snapshot, so all tables it reads belong together."""
        return HistoryStore(self.spark, self.root, self.versions_per_bucket, self.snapshot())

    def _switch(self, old: Snapshot, folders: dict[tuple[str, int | None], str], batches: dict[str, int]) -> None:
        rows = [(HEAD, None, "")]
        rows += [(table, bucket, generation) for (table, bucket), generation in folders.items()]
        rows += [(BATCH, number, stream) for stream, number in batches.items()]
        made = self.spark.createDataFrame(rows, SNAPSHOT).coalesce(1)
        made.write.mode("errorifexists").parquet(f"{self.path('snapshot')}/number={old.number + 1}")

    def vacuum(self) -> None:
        """Remove what the newest snapshot does not name: replaced buckets, interrupted writes, older snapshots."""
        now = self.snapshot()
        named = set(now.folders.values())
        for table in schemas.TABLES:
            for name in folder_names(self.spark, self.path(table)):
                generation = name.removeprefix("generation=")
                if name == generation:
                    continue
                if generation not in named and table != RUNS:
                    remove_folder(self.spark, f"{self.path(table)}/{name}")
                    continue
                for part in folder_names(self.spark, f"{self.path(table)}/{name}"):
                    if part.startswith(f"{BUCKET}=") and now.folders.get((table, int(part.split("=")[1]))) != generation:
                        remove_folder(self.spark, f"{self.path(table)}/{name}/{part}")
        for name in folder_names(self.spark, self.path("snapshot")):
            if name.startswith("number=") and int(name.split("=")[1]) < now.number:
                remove_folder(self.spark, f"{self.path('snapshot')}/{name}")

    # --- reading

    def read(self, table: str) -> DataFrame:
        """A table's rows in the newest snapshot; without any of its rows in there, no rows."""
        if table == "meta":
            return read_table(self.spark, self.root, table)
        if table == RUNS:
            return read_table(self.spark, self.path(table), f"generation={self._ledger()}", schemas.ANALYSIS_RUN)
        now = self.snapshot()
        if table not in schemas.TABLES or not now.number:
            raise MissingTable(f"no table {table} under {self.root}")
        return self._folders(table, now.of(table)).select(*schemas.TABLES[table].names)

    def _folders(self, table: str, folders: dict[int | None, str]) -> DataFrame:
        """Rows of some buckets with their bucket number, which is a partition column."""
        schema = schemas.TABLES[table]
        if None in folders:
            return self.spark.read.schema(schema).parquet(f"{self.path(table)}/generation={folders[None]}")
        full = T.StructType([*schema.fields, T.StructField("generation", T.StringType()), T.StructField(BUCKET, T.LongType())])
        if not folders:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.path(table)}/generation={g}/{BUCKET}={bucket}" for bucket, g in sorted(folders.items())]
        return self.spark.read.schema(full).option("basePath", self.path(table)).parquet(*paths)

    def exists(self, table: str) -> bool:
        if table in ("meta", RUNS):
            try:
                self.read(table)
            except MissingTable:
                return False
            return True
        return bool(self.snapshot().of(table))

    def check(self, project: DataFrame | None = None) -> None:
        """Refuse a store of another schema version, and a project of another scope than the stored one."""
        if self.exists("meta"):
            assert_compatible(self.read("meta").agg(F.max("schema_version").alias("v")).first()["v"])
        if project is not None and self.exists("project"):
            found = sorted(r["field"] for r in scope_conflicts(self.read("project"), project).select("field").collect())
            if found:
                raise ScopeConflict(f"the store has another {', '.join(found)}; rebuild it or keep the scope")

    def has_batch(self, batch: tuple[str, int] | None) -> bool:
        """Whether a stream's batch is stored already."""
        return batch is not None and self.snapshot().batches.get(batch[0], -1) >= batch[1]

    # --- writing

    def _bucket(self, order: str = "version_order") -> Column:
        return F.coalesce(F.floor(F.col(order) / self.versions_per_bucket), F.lit(-1)).cast("long").alias(BUCKET)

    def _write(self, table: str, rows: DataFrame, generation: str) -> None:
        """Sorted inside files by key, so row groups can be skipped on version and module.

        The rebalance keeps a bucket together where it is small and splits it
        where it is large.
        """
        (
            rows.hint("rebalance", BUCKET)
            .sortWithinPartitions(BUCKET, *schemas.KEYS.get(table, ("version_id",)))
            .write.mode("append")
            .partitionBy(BUCKET)
            .parquet(f"{self.path(table)}/generation={generation}")
        )

    def _buckets(self, table: str, generation: str) -> list[int]:
        names = folder_names(self.spark, f"{self.path(table)}/generation={generation}")
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")]

    def stage(self, versions: DataFrame, tables: dict[str, DataFrame], failures: DataFrame | None) -> str:
        """Measure and write rows of some versions to a generation that no snapshot names yet.

        A write that fails takes its folders with it.
        """
        generation = uuid.uuid4().hex
        # A written table has a size: it goes to the rows, which are not shuffled by their few versions.
        orders = stored(versions.select("version_id", self._bucket()), "orders")
        given = dict(tables) if failures is None else {**tables, "failure": failures}
        try:
            for table, rows in given.items():
                fresh = conform(rows, schemas.TABLES[table])
                placed = fresh.withColumn(BUCKET, self._bucket()) if table == "version" else fresh.join(orders, "version_id")
                self._write(table, placed, generation)
        except Exception:
            self.discard(generation)
            raise
        return generation

    def discard(self, generation: str) -> None:
        for table in schemas.TABLES:
            if folder_names(self.spark, f"{self.path(table)}/generation={generation}"):
                remove_folder(self.spark, f"{self.path(table)}/generation={generation}")

    def staged(self, table: str, generations: Sequence[str]) -> DataFrame:
        """Rows of staged generations, from their folders."""
        parts = [self._folders(table, dict.fromkeys(self._buckets(table, g), g)) for g in generations]
        return reduce(DataFrame.unionByName, parts)

    def merged(self, table: str, stored: dict[int | None, str], generations: Sequence[str], buckets: Sequence[int]) -> DataFrame:
        """New rows of some buckets: only these buckets of the stored table are read."""
        inside = F.col(BUCKET).isin(list(buckets))
        fresh = self.staged(table, generations).where(inside).drop("generation")
        old = self._folders(table, {b: stored[b] for b in buckets if b in stored}).where(inside).drop("generation")
        if table not in schemas.KEYS:
            return old.unionByName(fresh)
        return upsert_rows(old, fresh, schemas.KEYS[table])

    def commit(
        self,
        generations: Sequence[str],
        replace: bool = False,
        batch: tuple[str, int] | None = None,
        project: DataFrame | None = None,
        run_id: str | None = None,
    ) -> None:
        """Make staged rows count, all at once: insert or replace by key, failures added.

        A bucket that only one generation holds is taken as it lies; others are merged
        into a new folder. ``replace`` leaves nothing but the staged rows and the run's entries.
        """
        old, generation = self.snapshot(), uuid.uuid4().hex
        folders = {} if replace else dict(old.folders)
        batches = {} if replace else dict(old.batches)
        for table in schemas.TABLES:
            held: dict[int, list[str]] = {}
            for g in generations:
                for bucket in self._buckets(table, g):
                    held.setdefault(bucket, []).append(g)
            shared = [b for b, gs in held.items() if len(gs) > 1 or (table, b) in folders]
            if shared:
                stored = {} if replace else old.of(table)
                self._write(table, self.merged(table, stored, generations, shared), generation)
            for bucket, gs in held.items():
                folders[(table, bucket)] = generation if bucket in shared else gs[0]
        if project is not None:
            fresh = conform(project, schemas.PROJECT)
            rows = upsert_project(self.read("project"), fresh) if old.of("project") and not replace else fresh
            rows.coalesce(1).write.parquet(f"{self.path('project')}/generation={generation}")
            folders[("project", None)] = generation
        if replace:
            if run_id is not None:
                self._write_run(self.read(RUNS).where(F.col("run_id") == run_id), generation)
            folders[(RUNS, None)] = generation
        if batch is not None:
            batches[batch[0]] = batch[1]
        self._switch(old, folders, batches)
        for g in generations:
            for table in schemas.TABLES:  # merged rows are elsewhere now
                for bucket in self._buckets(table, g):
                    if folders.get((table, bucket)) != g:
                        remove_folder(self.spark, f"{self.path(table)}/generation={g}/{BUCKET}={bucket}")
        if not self.exists("meta"):
            self.write_meta(TOOL_VERSION)

    def _stage_versions(self, versions: DataFrame, tables: Sequence[str], generations: Sequence[str]) -> str:
        """Stage the version rows to record, by what was staged for them."""
        none = self.spark.createDataFrame([], "version_id string")
        found = [self.staged(t, generations).select("version_id") for t in tables if t != "version"]
        failed = self.staged("failure", generations).select("version_id")
        return self.stage(versions, {"version": storable_versions(versions, failed, *(found or [none]))}, None)

    def upsert(self, table: str, incoming: DataFrame, versions: DataFrame) -> None:
        """Insert or replace rows of one table by key; ``versions`` gives their order."""
        self.commit([self.stage(versions, {table: incoming}, None)])

    def upsert_versions(
        self, versions: DataFrame, tables: dict[str, DataFrame], failures: DataFrame, batch: tuple[str, int] | None = None
    ) -> None:
        """All rows of some versions, visible together; a stream's batch is stored once however often it comes.

        Rows are measured once, into the folders that they stay in where their bucket
        is new. Whether a version is recorded depends on this call's rows and failures.
        """
        self.check()
        if not self.has_batch(batch):
            generations = [self.stage(versions, tables, failures)]
            self.store(versions, list(tables), generations, batch=batch)

    def rebuild(self, versions: DataFrame, tables: dict[str, DataFrame], failures: DataFrame) -> None:
        """Replace everything; readers keep the old rows until the new ones are whole."""
        self.store(versions, list(tables), [self.stage(versions, tables, failures)], replace=True)

    def store(
        self,
        versions: DataFrame,
        tables: Sequence[str],
        generations: Sequence[str],
        replace: bool = False,
        batch: tuple[str, int] | None = None,
        project: DataFrame | None = None,
        run_id: str | None = None,
    ) -> None:
        """Record the versions of staged rows and make all of it count."""
        recorded = self._stage_versions(versions, tables, generations)
        self.commit([*generations, recorded], replace, batch, project, run_id)
        if replace:
            self.write_meta(TOOL_VERSION)

    def write_project(self, project: DataFrame) -> None:
        """Insert or replace the project row."""
        self.commit([], project=project)

    def write_meta(self, tool_version: str) -> None:
        row = self.spark.range(1).select(
            F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
            F.lit(tool_version).alias("tool_version"),
            F.current_timestamp().alias("created_at"),
        )
        row.write.mode("overwrite").parquet(self.path("meta"))

    # --- run ledger

    def _ledger(self) -> str:
        return self.snapshot().folders.get((RUNS, None), FIRST)

    def _write_run(self, run: DataFrame, ledger: str) -> None:
        conform(run, schemas.ANALYSIS_RUN).write.mode("append").parquet(f"{self.path(RUNS)}/generation={ledger}")

    def append_run(self, run: DataFrame) -> None:
        """A ledger entry; a finished run is a second entry with the same id."""
        self._write_run(run, self._ledger())

    def start_run(self, run_id: str, **fields: object) -> None:
        """The ledger entry of a run that begins now."""
        row = {"run_id": run_id, "status": "running", "started_at": F.current_timestamp(), **fields}
        columns = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in row.items()]
        self.append_run(self.spark.range(1).select(*columns))

    def finish_run(self, run_id: str, status: str, **fields: object) -> None:
        """The entry of its end; it keeps what the start entry says."""
        started = self.read(RUNS).where((F.col("run_id") == run_id) & (F.col("status") == "running"))
        ended = {"status": F.lit(status), "finished_at": F.current_timestamp(), **{k: F.lit(v) for k, v in fields.items()}}
        self.append_run(cut_lineage(started.withColumns(ended)))

    def runs(self) -> DataFrame:
        """The current state of every run."""
        return latest_runs(self.read(RUNS))


def latest_runs(entries: DataFrame, order: Column | str | None = None) -> DataFrame:
    """Current state per run id: finished entries beat the start entry."""
    if order is None:
        order = F.coalesce("finished_at", "started_at")
    return newest(entries, ["run_id"], order)


def upsert_project(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_rows(existing, incoming, ["project_id"])


def scope_conflicts(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """What an incremental run would change in the stored project: it is refused if any row comes back."""
    fields = ("branch", "profile", "module_prefixes", "include_modules", "all_modules")

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = [F.struct(F.lit(f).alias("field"), F.to_json(F.struct(f)).alias(name)) for f in fields]
        return df.select("project_id", F.explode(F.array(*pairs)).alias("p")).select("project_id", "p.*")

    return (
        long(stored, "stored")
        .join(long(asked, "asked"), ["project_id", "field"])
        .where(~F.col("stored").eqNullSafe(F.col("asked")))
    )
