"""Reads at one version, and rankings over the latest one.

A version is chosen by a scalar subquery, so the choice reaches the scan as a
filter and no version list passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histmetrics.functions.text import top_folder
from histmetrics.functions.values import metric_at, metric_key_of
from histmetrics.operators.graph import edge_included, in_scope_depends, module_scores
from histmetrics.sources.store import BUCKET


def project_info(project: DataFrame, versions: DataFrame) -> DataFrame:
    """The project row with the number of stored versions."""
    count = versions.agg(F.count(F.lit(1)).alias("version_count"))
    return project.limit(1).withColumn("version_count", count.scalar())


def timeline(versions: DataFrame) -> DataFrame:
    return versions.select("version_id", "version_order", "authored_at", "summary").orderBy("version_order")


def latest_version(versions: DataFrame) -> DataFrame:
    """Id of the version with the greatest order."""
    return versions.agg(F.max_by("version_id", "version_order").alias("version_id"))


def resolve_version(versions: DataFrame, selector: str | int | None = None) -> DataFrame:
    """One row with the chosen version id; an unknown selector fails the query.

    A selector is a version id or an order number; none means the latest.
    """
    if selector is None:
        return latest_version(versions)
    text = str(selector)
    hit = (F.col("version_id") == text) | (F.col("version_order").cast("string") == text)
    found = versions.where(hit).agg(F.min_by("version_id", "version_order").alias("version_id"))
    missing = F.raise_error(F.lit(f"unknown version: {text}")).cast("string")
    return found.select(F.coalesce("version_id", missing).alias("version_id"))


def at_version(table: DataFrame, versions: DataFrame, selector: str | int | None = None) -> DataFrame:
    """Rows of any table at one version; of a stored table only the version's bucket is opened."""
    chosen = resolve_version(versions, selector)
    rows = table.where(F.col("version_id") == chosen.scalar())
    if BUCKET in table.columns and BUCKET in versions.columns:
        bucket = versions.where(F.col("version_id") == chosen.scalar()).agg(F.max(BUCKET).alias(BUCKET))
        rows = rows.where(F.col(BUCKET) == bucket.scalar())
    return rows


def latest_snapshot(table: DataFrame, versions: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    rows = at_version(table, versions)
    return rows.select(*columns) if columns else rows


def module_snapshot(modules: DataFrame, versions: DataFrame, selector: str | int | None = None) -> DataFrame:
    return (
        at_version(modules, versions, selector)
        .select("version_id", "module", "total_lines", "metrics", "line_counts", "distributions")
        .orderBy("module")
    )


def file_snapshot(
    files: DataFrame, versions: DataFrame, selector: str | int | None = None, module: str | None = None
) -> DataFrame:
    rows = at_version(files, versions, selector)
    if module is not None:
        rows = rows.where(F.col("module") == module)
    return rows.select(
        "version_id", "module", "relative_path", "line_category_id", "metrics", "line_counts", "distributions"
    ).orderBy("module", "relative_path")


def graph_nodes(modules: DataFrame, versions: DataFrame, selector: str | int | None = None) -> DataFrame:
    return at_version(modules, versions, selector).select(
        "version_id", "module", "total_lines", "metrics", "line_counts"
    )


def graph_edges(
    edges: DataFrame, versions: DataFrame, selector: str | int | None = None, include_zero: bool = False
) -> DataFrame:
    return edges_ranked(
        at_version(edges, versions, selector)
        .where(edge_included(include_zero=include_zero))
        .select("version_id", "source", "target", "score", "kinds", "kind_occurrence_count", "breakdown")
    )


def edges_ranked(edges: DataFrame) -> DataFrame:
    """Highest score first, ties by name."""
    return edges.orderBy(F.desc("score"), "source", "target")


def relations(
    edges: DataFrame, versions: DataFrame, selector: str | int | None = None, include_zero: bool = False
) -> DataFrame:
    """Relation rows with empty type literals and the score as strength."""
    blank = F.lit("")
    row_id = F.concat(F.col("source"), F.lit("->"), F.col("target"), F.lit(":"), blank)
    return (
        at_version(edges, versions, selector)
        .where(edge_included(include_zero=include_zero))
        .select(
            row_id.alias("row_id"),
            F.col("source").alias("source_id"),
            F.col("source").alias("source_label"),
            F.col("target").alias("target_id"),
            F.col("target").alias("target_label"),
            blank.alias("relation_type_id"),
            blank.alias("relation_type_label"),
            blank.alias("strength_metric_id"),
            blank.alias("strength_metric_label"),
            F.col("score").cast("double").alias("strength_value"),
            "version_id",
        )
        .orderBy(F.desc("strength_value"), "source_id", "target_id")
    )


def entities(df: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Entity targets of a kind (``*.module`` or ``*.file``), by id; all of them unless a limit is given."""
    if kind.endswith(".module"):
        ident = path = F.col("module")
    elif kind.endswith(".file"):
        ident = F.concat_ws("/", "module", "relative_path")
        path = F.col("relative_path")
    else:
        raise ValueError(f"unknown entity kind: {kind}")
    found = df.select(ident.alias("id"), F.lit(kind).alias("kind"), ident.alias("label"), path.alias("path"))
    found = found.distinct().orderBy("id")
    return found if limit is None else found.limit(limit)


def scope_modules(
    modules: DataFrame,
    prefixes: Sequence[str] = (),
    include: Sequence[str] = (),
    all_modules: bool = False,
    column: str = "module",
) -> DataFrame:
    """Modules by prefix or by name; no condition at all means every module."""
    if all_modules or not (prefixes or include):
        return modules
    keep = F.col(column).isin(*include) if include else F.lit(False)
    for prefix in sorted(set(prefixes)):
        keep = keep | F.col(column).startswith(prefix)
    return modules.where(keep)


def collapse_path(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def within_root(paths: DataFrame, root: str, column: str = "path") -> DataFrame:
    """Paths resolved against the root, flagged by whether they stay at or under it."""
    base = "/" + root.strip("/")
    p = F.col(column)
    resolved = collapse_path(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base + "/"), p)))
    inside = (F.col("resolved") == base) | F.col("resolved").startswith(base + "/")
    return paths.withColumn("resolved", resolved).withColumn("inside", inside)


def limit_with_flag(df: DataFrame, limit: int, order: Sequence[Column | str]) -> DataFrame:
    """The first rows in order, each telling whether rows were cut off."""
    few = df.orderBy(*order).limit(limit + 1)
    numbered = few.withColumn("row_number", F.row_number().over(Window.orderBy(*order)))
    cut = F.max("row_number").over(Window.partitionBy(F.lit(1))) > limit
    return numbered.withColumn("truncated", cut).where(F.col("row_number") <= limit)


def filter_categories(df: DataFrame, categories: Sequence[str], column: str = "line_category_id") -> DataFrame:
    """Rows of the chosen categories; an empty choice keeps all, NULL included."""
    return df.where(F.col(column).isin(*categories)) if categories else df


def _entity_name(level: str) -> Column:
    if level == "module":
        return F.col("module")
    if level == "file":
        return F.concat_ws("/", "module", "relative_path")
    raise ValueError(f"level must be module or file, got {level!r}")


def hotspots(
    table: DataFrame,
    versions: DataFrame,
    metric: str = "cyclomatic",
    agg: str = "mean",
    level: str = "module",
    limit: int = 20,
    by: str = "value",
) -> DataFrame:
    """Top entities by value at the latest version, or by growth since their first one.

    By value, ``first`` and ``growth`` stay NULL as they do in stored answers.
    """
    name, value = _entity_name(level), metric_at("metrics", metric_key_of(metric, agg))
    if by == "value":
        return (
            latest_snapshot(table, versions)
            .select(
                name.alias("name"),
                value.alias("current"),
                F.lit(None).cast("double").alias("first"),
                F.lit(None).cast("double").alias("growth"),
            )
            .where(F.col("current").isNotNull())
            .orderBy(F.desc("current"), "name")
            .limit(limit)
        )
    if by != "growth":
        raise ValueError(f"by must be value or growth, got {by!r}")
    ordered = versions.select("version_id", "version_order")
    latest = versions.agg(F.max("version_order")).scalar()
    return (
        table.select("version_id", name.alias("name"), value.alias("value"))
        .where(F.col("value").isNotNull())
        .join(ordered, "version_id")
        .groupBy("name")
        .agg(
            F.max_by("value", "version_order").alias("current"),
            F.min_by("value", "version_order").alias("first"),
            F.max("version_order").alias("last_order"),
        )
        .where(F.col("last_order") == latest)
        .select("name", "current", "first", (F.col("current") - F.col("first")).alias("growth"))
        .orderBy(F.desc("growth"), "name")
        .limit(limit)
    )


# --- details --------------------------------------------------------------------


def failures_at(failures: DataFrame, versions: DataFrame, selector: str | int | None = None) -> DataFrame:
    return at_version(failures, versions, selector).select("version_id", "file_path", "error_text")


def module_models_at(models: DataFrame, versions: DataFrame, selector: str | int | None = None) -> DataFrame:
    """Declared and inherited models per module (output of ``module_models``)."""
    return at_version(models, versions, selector).select("module", "role", "model")


def depends_at(
    manifests: DataFrame, modules: DataFrame, versions: DataFrame, selector: str | int | None = None
) -> DataFrame:
    here = at_version(manifests, versions, selector)
    known = at_version(modules.select("version_id", "module"), versions, selector)
    return in_scope_depends(here, known).select("module", F.explode("manifest_depends").alias("depends_on"))


def _dist(family: str, stat: str) -> Column:
    return F.try_element_at(F.col("distributions"), F.lit(family))[stat]


def module_detail(
    modules: DataFrame,
    edges: DataFrame,
    versions: DataFrame,
    families: Sequence[str],
    selector: str | int | None = None,
    parse_errors: DataFrame | None = None,
) -> DataFrame:
    """Module rows with their distributions, scores and parse errors.

    ``method_count`` is the count of the first family's distribution.
    """
    here = at_version(modules, versions, selector)
    scores = module_scores(here, at_version(edges, versions, selector))
    out = here.join(scores, ["version_id", "module"])
    if parse_errors is not None:
        out = out.join(parse_errors.select("version_id", "module", "parse_error_count"), ["version_id", "module"], "left")
    else:
        out = out.withColumn("parse_error_count", F.lit(0))
    stats = [
        _dist(f, s).alias(f"{f}_{s}") for f in families for s in ("count", "mean", "median", "p95", "max")
    ]
    return out.select(
        "module",
        "total_lines",
        *stats,
        _dist(families[0], "count").alias("method_count"),
        F.col("incoming_score").alias("score_in"),
        F.col("outgoing_score").alias("score_out"),
        F.coalesce("parse_error_count", F.lit(0)).cast("long").alias("parse_error_count"),
    )


def file_detail(
    files: DataFrame,
    versions: DataFrame,
    families: Sequence[str],
    selector: str | int | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """File rows with their distributions, top folder and parse error."""
    out = at_version(files, versions, selector).withColumn("name", F.concat_ws("/", "module", "relative_path"))
    if failures is not None:
        errors = at_version(failures, versions, selector).groupBy(F.col("file_path").alias("name")).agg(
            F.min("error_text").alias("parse_error")
        )
        out = out.join(errors, "name", "left")
    else:
        out = out.withColumn("parse_error", F.lit(None).cast("string"))
    stats = [_dist(f, s).alias(f"{f}_{s}") for f in families for s in ("count", "mean", "median", "p95", "max")]
    return out.select(
        "name",
        top_folder("relative_path").alias("top_folder"),
        "line_category_id",
        metric_at("line_counts", "lines").cast("long").alias("lines"),
        *stats,
        "parse_error",
    )
