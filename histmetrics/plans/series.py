"""Values over versions, and differences between two versions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmetrics.functions.catalog import KIND_GROUP
from histmetrics.functions.values import metric_at, metric_key_of, metric_value
from histmetrics.operators.graph import edge_included, group_of
from histmetrics.plans.reads import at_version


def _ordered(versions: DataFrame) -> DataFrame:
    return versions.select("version_id", "version_order")


def module_timeseries(
    modules: DataFrame, versions: DataFrame, module: str, metric: str = "cyclomatic", agg: str = "mean"
) -> DataFrame:
    """One metric of one module by version; a missing key reads as NULL."""
    return (
        modules.where(F.col("module") == module)
        .select("version_id", metric_at("metrics", metric_key_of(metric, agg)).alias("value"))
        .join(_ordered(versions), "version_id")
        .select("version_order", "version_id", "value")
        .orderBy("version_order")
    )


def file_timeseries(
    files: DataFrame,
    versions: DataFrame,
    module: str,
    relative_path: str,
    metric: str = "cyclomatic",
    agg: str = "mean",
) -> DataFrame:
    mine = files.where((F.col("module") == module) & (F.col("relative_path") == relative_path))
    return (
        mine.select("version_id", metric_at("metrics", metric_key_of(metric, agg)).alias("value"))
        .join(_ordered(versions), "version_id")
        .select("version_order", "version_id", "value")
        .orderBy("version_order")
    )


def scalar_series(modules: DataFrame, versions: DataFrame, metric: str, agg: str = "mean") -> DataFrame:
    """Metrics that are single numbers (``lines``, ``python_file_count``) for every module."""
    if metric == "lines":
        value = F.col("total_lines").cast("double")
    else:
        value = metric_value("metrics", "line_counts", metric, agg)
    return (
        modules.select("version_id", "module", value.alias("value"))
        .join(_ordered(versions), "version_id")
        .select("module", "version_order", "version_id", "value")
    )


def lines_by_category_series(modules: DataFrame, versions: DataFrame) -> DataFrame:
    """One series per module and line category."""
    return (
        modules.select("version_id", "module", F.explode("line_counts").alias("category", "lines"))
        .join(_ordered(versions), "version_id")
        .select("module", "category", "version_order", "version_id", "lines")
    )


def structure_timeseries(edges: DataFrame, versions: DataFrame, include_zero: bool = False) -> DataFrame:
    """Edge count and total score of every version; versions without edges give zeros."""
    sums = (
        edges.where(edge_included(include_zero=include_zero))
        .groupBy("version_id")
        .agg(F.count(F.lit(1)).alias("edge_count"), F.sum("score").alias("total_score"))
    )
    return _ordered(versions).join(sums, "version_id", "left").select(
        "version_order",
        "version_id",
        F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count"),
        F.coalesce("total_score", F.lit(0)).cast("long").alias("total_score"),
    )


def edge_kind_series(edges: DataFrame, versions: DataFrame, kind: str | None = None) -> DataFrame:
    """Occurrences per kind over versions."""
    counts = edges.select("version_id", F.explode("kinds").alias("kind", "n"))
    if kind is not None:
        counts = counts.where(F.col("kind") == kind)
    return (
        counts.groupBy("version_id", "kind")
        .agg(F.sum("n").cast("long").alias("occurrences"))
        .join(_ordered(versions), "version_id")
        .select("kind", "version_order", "version_id", "occurrences")
    )


def relations_diff(
    edges: DataFrame, versions: DataFrame, before: str | int, after: str | int, include_zero: bool = False
) -> DataFrame:
    """Relations added or removed between two versions, with both scores."""
    included = edges.where(edge_included(include_zero=include_zero))
    pair = ["source", "target"]
    a = at_version(included, versions, before).select(*pair, F.col("score").alias("score_a"))
    b = at_version(included, versions, after).select(*pair, F.col("score").alias("score_b"))
    change = F.when(F.col("score_a").isNull(), "added").when(F.col("score_b").isNull(), "removed")
    return a.join(b, pair, "full").withColumn("change", change).where(F.col("change").isNotNull()).select(
        *pair, "change", "score_a", "score_b"
    )


def edge_points(
    pairs: DataFrame,
    edges: DataFrame,
    versions: DataFrame,
    selector: str | int | None = None,
    include_zero: bool = False,
    kind_group: Mapping[str, str] = KIND_GROUP,
) -> DataFrame:
    """Points per group of the requested pairs, each with the kinds behind it.

    A pair that is absent or excluded gives one row with ``missing`` set. The
    explanation joins at most one entry per kind.
    """
    here = at_version(edges, versions, selector).where(edge_included(include_zero=include_zero))
    by_kind = here.select("source", "target", F.explode("kinds").alias("kind", "n")).withColumn(
        "category", group_of("kind", kind_group)
    )
    told = F.concat(F.col("kind"), F.lit("="), F.col("n").cast("string"))
    points = (
        by_kind.where(F.col("category").isNotNull())
        .groupBy("source", "target", "category")
        .agg(
            F.sum("n").cast("long").alias("points"),
            F.array_join(F.array_sort(F.collect_list(told)), ", ").alias("why_points"),
        )
    )
    found = here.select("source", "target", F.lit(True).alias("found"))
    return (
        pairs.select("source", "target")
        .distinct()
        .join(found, ["source", "target"], "left")
        .join(points, ["source", "target"], "left")
        .select("source", "target", "category", "points", "why_points", F.col("found").isNull().alias("missing"))
    )


def edge_evidence(
    facts: DataFrame, edges: DataFrame, versions: DataFrame, selector: str | int | None = None,
    include_zero: bool = False,
) -> DataFrame:
    """The unreduced facts behind the edges a read shows."""
    shown = edges.where(edge_included(include_zero=include_zero)).select("version_id", "source", "target")
    here = at_version(facts, versions, selector)
    return here.join(
        at_version(shown, versions, selector), ["version_id", "source", "target"], "left_semi"
    ).select("source", "target", "kind", "file_path", "line", "detail")
