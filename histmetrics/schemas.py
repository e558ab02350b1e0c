"""Stored tables: one StructType each, plus keys and the schema version."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 4

DISTRIBUTION = T.StructType(
    [
        T.StructField("count", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("p95", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
    ]
)
METRICS = T.MapType(T.StringType(), T.DoubleType())
COUNTS = T.MapType(T.StringType(), T.LongType())
KINDS = T.MapType(T.StringType(), T.LongType())
DISTRIBUTIONS = T.MapType(T.StringType(), DISTRIBUTION)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampType(),
)

VERSION = _struct(
    version_id=_S,
    version_order=_I,
    author_name=_S,
    author_email=_S,
    authored_at=_TS,
    committed_at=_TS,
    summary=_S,
)
FILE_METRIC = _struct(
    version_id=_S,
    module=_S,
    relative_path=_S,
    line_category_id=_S,
    metrics=METRICS,
    line_counts=COUNTS,
    distributions=DISTRIBUTIONS,
)
MODULE_AGGREGATE = _struct(
    version_id=_S,
    module=_S,
    total_lines=_L,
    metrics=METRICS,
    line_counts=COUNTS,
    distributions=DISTRIBUTIONS,
    manifest_depends=T.ArrayType(_S),
)
COUPLING_EDGE = _struct(
    version_id=_S,
    source=_S,
    target=_S,
    score=_L,
    kinds=KINDS,
    kind_occurrence_count=_L,
    breakdown=KINDS,
)
FAILURE = _struct(run_id=_S, version_id=_S, file_path=_S, error_text=_S)
ANALYSIS_RUN = _struct(
    run_id=_S,
    branch=_S,
    mode=_S,
    status=_S,
    started_at=_TS,
    finished_at=_TS,
    versions_total=_I,
    versions_succeeded=_I,
    versions_failed=_I,
)
PROJECT = _struct(
    project_id=_S,
    repo_path=_S,
    branch=_S,
    profile=_S,
    project_label=_S,
    module_prefixes=T.ArrayType(_S),
    include_modules=T.ArrayType(_S),
    all_modules=_B,
)
META = _struct(schema_version=_I, tool_version=_S, created_at=_TS)

TABLES: dict[str, T.StructType] = {
    "meta": META,
    "project": PROJECT,
    "analysis_run": ANALYSIS_RUN,
    "version": VERSION,
    "file_metric": FILE_METRIC,
    "module_aggregate": MODULE_AGGREGATE,
    "coupling_edge": COUPLING_EDGE,
    "failure": FAILURE,
}

# Primary keys; ``failure`` is append-only and has none.
KEYS: dict[str, tuple[str, ...]] = {
    "project": ("project_id",),
    "analysis_run": ("run_id",),
    "version": ("version_id",),
    "file_metric": ("version_id", "module", "relative_path"),
    "module_aggregate": ("version_id", "module"),
    "coupling_edge": ("version_id", "source", "target"),
}

PROGRESS_EVENT = _struct(
    type=_S,
    run_id=_S,
    branch=_S,
    mode=_S,
    commits_total=_I,
    processed=_I,
    short_hash=_S,
    commits_succeeded=_I,
    commits_failed=_I,
    duration_ms=_L,
    exit_reason=_S,
    message=_S,
    stderr_tail=_S,
)


def _rows(schema: T.StructType, *drop: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([f for f in schema.fields if f.name not in drop]))


# One JSON line: a version and (a slice of) the rows measured at it.
BATCH = T.StructType(
    [
        T.StructField("commit", VERSION),
        T.StructField("files", _rows(FILE_METRIC, "version_id")),
        T.StructField("modules", _rows(MODULE_AGGREGATE, "version_id")),
        T.StructField("edges", _rows(COUPLING_EDGE, "version_id")),
        T.StructField("failures", _rows(FAILURE, "version_id")),
    ]
)
