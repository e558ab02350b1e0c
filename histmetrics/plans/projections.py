"""Rows in the shapes that tables, graphs and treemaps show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histmetrics.functions import catalog
from histmetrics.functions.values import category_label, metric_label, nested_at


def graph_edge_projection(edges: DataFrame, *extra: str) -> DataFrame:
    """Edge id ``a->b`` and relation type: the first kind by name, or ``imports``."""
    first = F.array_min(F.map_keys("kinds"))
    return edges.select(
        *extra,
        F.concat(F.col("source"), F.lit("->"), F.col("target")).alias("id"),
        "source",
        "target",
        F.coalesce(first, F.lit("imports")).alias("relation_type_id"),
        F.col("score").cast("double").alias("score"),
    )


def graph_node_projection(nodes: DataFrame, kind: str = "python.module") -> DataFrame:
    """Node rows with metrics as an array of (metric_id, value)."""
    values = F.transform(
        F.map_entries("metrics"),
        lambda e: F.struct(e["key"].alias("metric_id"), e["value"].cast("double").alias("value")),
    )
    return nodes.select(
        F.col("module").alias("id"), F.lit(kind).alias("kind"), values.alias("metrics"), "line_counts"
    )


def table_projection(df: DataFrame, table: str) -> DataFrame:
    """Table rows with a stable row id and, for modules, the key to drill down by."""
    if table == "modules":
        row_id, drill = F.col("module"), F.col("module")
    elif table == "files":
        row_id, drill = F.concat_ws("/", "module", "relative_path"), F.lit(None).cast("string")
    elif table == "relations":
        row_id = F.concat(F.col("source_id"), F.lit("->"), F.col("target_id"), F.lit(":"), F.col("relation_type_id"))
        drill = F.lit(None).cast("string")
    else:
        raise ValueError(f"unknown table: {table}")
    return df.withColumn("row_id", row_id).withColumn("drilldown_key", drill)


def map_columns(df: DataFrame, column: str = "line_counts", displayable: bool = False) -> DataFrame:
    """Distinct keys of a map column with the number of rows that carry them.

    ``displayable`` leaves out NULL and zero values.
    """
    keys = df.select(F.explode(column).alias("key", "value"))
    if displayable:
        keys = keys.where(F.col("value").isNotNull() & (F.col("value") != 0))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


def widen_map(df: DataFrame, column: str, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Chosen map keys as scalar columns, so that scans can prune and filter on them."""
    return df.select(
        *[c for c in df.columns if c != column],
        *[F.try_element_at(F.col(column), F.lit(k)).alias(prefix + k) for k in keys],
    )


def treemap_items(rows: DataFrame, size: str = "line_counts.lines") -> DataFrame:
    """Treemap items: size at least zero, group by category, largest first."""
    value = F.coalesce(nested_at(size).try_cast("double"), F.lit(0.0))
    return rows.select(
        F.concat_ws("/", "module", "relative_path").alias("id"),
        F.col("relative_path").alias("label"),
        F.col("line_category_id").alias("group"),
        F.greatest(F.lit(0.0), value).alias("size"),
    ).orderBy(F.desc("size"), "id")


def legend_groups(items: DataFrame) -> DataFrame:
    return items.select(F.coalesce("group", F.lit("")).alias("group")).distinct()


# --- catalog dimensions -----------------------------------------------------------


def catalog_metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        catalog.METRICS,
        "metric_id string, label string, scope string, unit string, default_enabled boolean, per_file boolean",
    )


def catalog_options(spark: SparkSession, kind: str) -> DataFrame:
    """Options of one kind: relation_type, line_category, aggregation, node_size, link_thickness."""
    rows = {
        "relation_type": catalog.RELATION_TYPES,
        "line_category": catalog.CATEGORY_OPTIONS,
        "aggregation": catalog.AGGREGATIONS,
        "node_size": catalog.NODE_SIZE_OPTIONS,
        "link_thickness": catalog.LINK_THICKNESS_OPTIONS,
    }[kind]
    out = spark.createDataFrame(rows, "id string, label string, default_enabled boolean")
    if kind == "line_category":
        alias = F.create_map(*[F.lit(x) for kv in catalog.CATEGORY_ALIAS.items() for x in kv])
        out = out.withColumn("stored_id", F.coalesce(F.try_element_at(alias, F.col("id")), F.col("id")))
    return out


def column_catalog(spark: SparkSession) -> DataFrame:
    """Column definitions of the file table: scalar metrics once, others per aggregation."""
    metrics = catalog_metrics(spark).where("per_file")
    scalar = F.col("metric_id").isin("lines", "function_count", "jones_line_count")
    aggs = F.array(
        *[F.struct(F.lit(i).alias("agg"), F.lit(label).alias("agg_label")) for i, label, _ in catalog.AGGREGATIONS]
    )
    none = F.array(F.struct(F.lit(None).cast("string").alias("agg"), F.lit(None).cast("string").alias("agg_label")))
    wide = metrics.select("metric_id", "label", F.explode(F.when(scalar, none).otherwise(aggs)).alias("a"))
    key = F.when(F.col("a.agg").isNull(), F.concat(F.lit("line_counts."), F.col("metric_id"))).otherwise(
        F.concat(F.lit("metrics."), F.col("metric_id"), F.lit("_"), F.col("a.agg"))
    )
    return wide.select(key.alias("key"), F.concat_ws(" ", "label", "a.agg_label").alias("label"), "metric_id")


def discovered_columns(files: DataFrame) -> DataFrame:
    """Columns a file table needs: every key in the data, with label and visibility."""
    counted = map_columns(files, "line_counts").select(
        F.concat(F.lit("line_counts."), F.col("key")).alias("key"),
        category_label("key").alias("label"),
        (F.col("key").isin(*[c[0] for c in catalog.CATEGORY_OPTIONS if c[2]]) | (F.col("key") == "lines")).alias(
            "visible_by_default"
        ),
        "rows",
    )
    measured = map_columns(files, "metrics").select(
        F.concat(F.lit("metrics."), F.col("key")).alias("key"),
        metric_label("key").alias("label"),
        F.lit(True).alias("visible_by_default"),
        "rows",
    )
    return counted.unionByName(measured)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requested (metric, level, agg) against the catalog: status and reason.

    An absent aggregation falls back to ``mean``; a level may be NULL.
    """
    spark = requests.sparkSession
    known = F.broadcast(catalog_metrics(spark).select(F.col("metric_id").alias("metric"), "scope"))
    aggs = [a[0] for a in catalog.AGGREGATIONS]
    chosen = F.coalesce("agg", F.lit("mean"))
    wrong_level = F.col("level").isNotNull() & (F.col("scope") != "both") & (F.col("level") != F.col("scope"))
    reason = (
        F.when(F.col("scope").isNull(), "unknown_metric")
        .when(wrong_level & (F.col("scope") == "module"), "module_scope_only")
        .when(wrong_level, "file_scope_only")
        .when(~chosen.isin(*aggs), "unknown_aggregation")
    )
    return (
        requests.join(known, "metric", "left")
        .withColumn("agg", chosen)
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "valid").otherwise("unavailable"))
        .drop("scope")
    )

