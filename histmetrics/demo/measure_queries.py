"""Distributions, counts, ordering."""

from pyspark.sql import functions as F

from histmetrics.demo import frames
from histmetrics.demo.registry import query
from histmetrics.demo.sql import CATEGORIES
from histmetrics.functions.text import line_count
from histmetrics.operators import measures, ordering
from histmetrics.plans import projections, reads

STATS = ("count", "mean", "median", "p95", "max")


def flat_stats(df, *keys, families=measures.FAMILIES):
    """Stored distributions as scalar columns."""
    return df.select(
        *keys,
        *[F.try_element_at("distributions", F.lit(f))[s].alias(f"{f}_{s}") for f in families for s in STATS],
    )


@query(
    "distribution",
    """SELECT version_id, family, count(*) AS count, avg(value) AS mean, median(value) AS median,
       list_sort(list(value))[greatest(1, CAST(ceil(CAST(0.95 AS DOUBLE) * count(*)) AS BIGINT))] AS p95, max(value) AS max
       FROM (SELECT version_id, family, value FROM x_obs) GROUP BY ALL""",
)
def _(spark, sf):
    return measures.distribution(frames.observations(spark, sf), ["version_id", "family"])


@query("file_distributions", "SELECT * FROM x_dist_f")
def _(spark, sf):
    return measures.file_distributions(frames.observations(spark, sf))


@query("module_distributions", "SELECT * FROM x_dist_m")
def _(spark, sf):
    return measures.module_distributions(frames.observations(spark, sf))


@query(
    "distributions_with_empty",
    """SELECT version_id, module, coalesce(count, 0) AS count, coalesce(mean, 0) AS mean, coalesce(median, 0) AS median,
       coalesce(p95, 0) AS p95, coalesce(max, 0) AS max FROM (SELECT DISTINCT version_id, module FROM x_line) LEFT JOIN
       (SELECT version_id, module, count(*) AS count, avg(lines) AS mean, median(lines) AS median,
       CAST(list_sort(list(lines))[greatest(1, CAST(ceil(CAST(0.95 AS DOUBLE) * count(*)) AS BIGINT))] AS DOUBLE) AS p95,
       CAST(max(lines) AS DOUBLE) AS max FROM x_line WHERE lines > 45 AND jones = 0 GROUP BY ALL) USING (version_id, module)""",
)
def _(spark, sf):
    lines = frames.lines(spark, sf)
    rare = lines.where((F.col("lines") > 45) & (F.col("jones") == 0))
    dist = measures.distribution(rare, ["version_id", "module"], "lines")
    return measures.with_empty(dist, frames.modules(spark, sf), ["version_id", "module"])


@query("line_counts", f"SELECT version_id, module, {', '.join(CATEGORIES)}, total_lines FROM x_lines_m")
def _(spark, sf):
    return frames.module_line_counts(spark, sf)


@query(
    "document_line_counts",
    "SELECT version_id, module, "
    + ", ".join(f"CAST(coalesce(sum(CASE WHEN line_category_id = '{c}' THEN lines END), 0) AS BIGINT) AS {c}" for c in CATEGORIES)
    + """, CAST(coalesce(sum(CASE WHEN line_category_id IS NOT NULL THEN lines END), 0) AS BIGINT) AS total_lines
       FROM x_doc_cat WHERE line_category_id IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    files = frames.document_files(spark, sf).withColumn("lines", line_count("content"))
    return measures.line_counts(measures.measure_files(files))


@query(
    "file_counts",
    """SELECT version_id, module, count(*) FILTER (WHERE relative_path LIKE '%.py' AND NOT is_test) AS python_file_count,
       count(*) FILTER (WHERE relative_path LIKE '%.py' AND NOT is_test AND doc_id % 3 = 0) AS parse_error_count
       FROM x_doc_cat GROUP BY ALL""",
)
def _(spark, sf):
    files = frames.document_files(spark, sf).withColumn("error", F.when(F.col("doc_id") % 3 == 0, "bad"))
    return measures.file_counts(files)


@query(
    "assemble_file_metrics",
    """SELECT version_id, module, relative_path, line_category_id, lines, cyclomatic_count AS function_count,
       jones_count AS jones_line_count, cyclomatic_p95, cognitive_median, jones_mean, cyclomatic_max FROM x_file""",
)
def _(spark, sf):
    counts, stats = F.col("line_counts"), F.col("metrics")
    return frames.file_metric(spark, sf).select(
        "version_id",
        "module",
        "relative_path",
        "line_category_id",
        *[counts[k].alias(k) for k in ("lines", "function_count", "jones_line_count")],
        *[stats[k].alias(k) for k in ("cyclomatic_p95", "cognitive_median", "jones_mean", "cyclomatic_max")],
    )


@query(
    "assemble_file_metrics_unmeasured",
    """SELECT version_id, module, relative_path, lines, coalesce(c, 0) AS function_count, m AS cyclomatic_mean
       FROM (SELECT version_id, module, relative_path, CAST(sum(lines) AS BIGINT) AS lines FROM x_line GROUP BY ALL)
       LEFT JOIN (SELECT version_id, module, relative_path, count(*) AS c, avg(value) AS m FROM x_obs
       WHERE family = 'cyclomatic' AND relative_path LIKE 'promo/%' GROUP BY ALL) USING (version_id, module, relative_path)""",
)
def _(spark, sf):
    some = frames.observations(spark, sf).where(F.col("relative_path").startswith("promo/"))
    files = measures.assemble_file_metrics(frames.file_lines(spark, sf), measures.file_distributions(some))
    return files.select(
        "version_id", "module", "relative_path", F.col("line_counts")["lines"].alias("lines"),
        F.col("line_counts")["function_count"].alias("function_count"),
        F.try_element_at("metrics", F.lit("cyclomatic_mean")).alias("cyclomatic_mean"),
    )


@query(
    "assemble_module_aggregates",
    "SELECT version_id, module, total_lines, python_file_count, python_lines, html_lines, "
    + ", ".join(f"{f}_{s}" for f in measures.FAMILIES for s in STATS)
    + " FROM x_module",
)
def _(spark, sf):
    rows = frames.module_aggregate(spark, sf)
    return flat_stats(
        rows.withColumn("python_file_count", F.col("metrics")["python_file_count"].cast("long"))
        .withColumn("python_lines", F.col("line_counts")["python_lines"])
        .withColumn("html_lines", F.col("line_counts")["html_lines"]),
        "version_id", "module", "total_lines", "python_file_count", "python_lines", "html_lines",
    )


@query(
    "run_outcome",
    """SELECT CAST(o_custkey AS VARCHAR) AS run_id,
       count(*) FILTER (WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0)) AS succeeded,
       count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS failed, count(*) AS processed
       FROM orders GROUP BY ALL""",
)
def _(spark, sf):
    flags = frames.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"),
        (F.col("o_orderkey") % 2 == 1).alias("has_metrics"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("failures"),
    )
    return measures.run_outcome(flags)


@query(
    "combined_metric",
    """SELECT version_id, module, relative_path, CASE WHEN lines > 40 THEN (cyclomatic_mean + jones_mean) / 2
       ELSE cyclomatic_mean END AS combined, CAST(NULL AS DOUBLE) AS nothing FROM x_file""",
)
def _(spark, sf):
    jones = F.when(F.col("line_counts")["lines"] > 40, F.col("metrics")["jones_mean"])
    absent = F.lit(None).cast("double")
    return frames.file_metric(spark, sf).select(
        "version_id", "module", "relative_path",
        measures.combined_metric([F.col("metrics")["cyclomatic_mean"], jones, absent]).alias("combined"),
        measures.combined_metric([absent]).alias("nothing"),
    )


@query(
    "treemap_items",
    """SELECT version_id, module || '/' || relative_path AS id, relative_path AS label, line_category_id AS "group",
       CAST(greatest(0, lines) AS DOUBLE) AS size FROM x_file WHERE version_id = (SELECT version_id FROM x_latest)""",
)
def _(spark, sf):
    versions = frames.versions(spark, sf)
    files = frames.file_metric(spark, sf, frames.is_version(versions))
    items = projections.treemap_items(reads.file_snapshot(files, versions))
    return items.withColumn("version_id", reads.latest_version(versions).scalar())


@query("legend_groups", 'SELECT DISTINCT line_category_id AS "group" FROM x_file')
def _(spark, sf):
    return projections.legend_groups(projections.treemap_items(frames.file_metric(spark, sf)))


# --- ordering ---------------------------------------------------------------------------

_CANDIDATES = """(SELECT version_id, module, path, seq, path LIKE '/b%' AS pref FROM (SELECT
    CAST(p_size AS VARCHAR) AS version_id, replace(p_brand, '#', '_') AS module,
    CASE WHEN p_partkey % 3 = 0 THEN '/b/' ELSE '/a/' END || CAST(p_partkey AS VARCHAR) AS path, p_partkey AS seq FROM part))"""
_WINNERS = f"""(SELECT version_id, module, min_by(path, seq) AS first_path, min(seq) AS first_seq,
    min_by(path, seq) FILTER (WHERE pref) AS pref_path, min(seq) FILTER (WHERE pref) AS pref_seq
    FROM {_CANDIDATES} GROUP BY ALL)"""


def _candidates(spark, sf):
    key = F.col("p_partkey")
    return frames.table(spark, sf, "part").select(
        F.col("p_size").cast("string").alias("version_id"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("module"),
        F.concat(F.when(key % 3 == 0, "/b/").otherwise("/a/"), key.cast("string")).alias("path"),
        key.alias("seq"),
    )


@query(
    "resolve_duplicates",
    f"SELECT version_id, module, first_path AS path, first_seq AS seq FROM {_WINNERS}",
)
def _(spark, sf):
    return ordering.resolve_duplicates(_candidates(spark, sf))[0]


@query(
    "duplicate_warnings",
    f"""SELECT version_id, module, first_path AS kept_path, path AS skipped_path FROM {_CANDIDATES}
        JOIN {_WINNERS} USING (version_id, module) WHERE seq <> first_seq""",
)
def _(spark, sf):
    return ordering.resolve_duplicates(_candidates(spark, sf))[1]


@query(
    "duplicates_prefer_prefix",
    f"""SELECT version_id, module, coalesce(pref_path, first_path) AS path, coalesce(pref_seq, first_seq) AS seq
        FROM {_WINNERS}""",
)
def _(spark, sf):
    return ordering.resolve_duplicates(_candidates(spark, sf), "prefer_prefix", "/b")[0]


@query(
    "prefer_prefix_warnings",
    f"""SELECT version_id, module, CASE WHEN pref_path IS NULL THEN first_path WHEN seq <> first_seq AND seq < pref_seq
        THEN first_path ELSE pref_path END AS kept_path, path AS skipped_path FROM {_CANDIDATES}
        JOIN {_WINNERS} USING (version_id, module) WHERE seq <> coalesce(pref_seq, first_seq)""",
)
def _(spark, sf):
    return ordering.resolve_duplicates(_candidates(spark, sf), "prefer_prefix", "/b")[1]


@query(
    "minmax_scale",
    """SELECT version_id, module, CASE WHEN v IS NULL THEN 0.0 WHEN hi <= lo THEN 0.5 ELSE (v - lo) / (hi - lo) END AS scaled
       FROM (SELECT *, min(v) OVER (PARTITION BY version_id) AS lo, max(v) OVER (PARTITION BY version_id) AS hi
       FROM (SELECT version_id, module, CASE WHEN total_lines % 5 <> 0 THEN CAST(total_lines AS DOUBLE) END AS v FROM x_module))""",
)
def _(spark, sf):
    rows = frames.module_line_counts(spark, sf).select(
        "version_id", "module",
        F.when(F.col("total_lines") % 5 != 0, F.col("total_lines").cast("double")).alias("v"),
    )
    return ordering.minmax_scale(rows, "v").select("version_id", "module", "scaled")


@query(
    "version_neighbors",
    """SELECT lower(hex(o_orderkey)) AS version_id, o_orderkey AS version_order,
       row_number() OVER (ORDER BY o_orderkey) - 1 AS position,
       lower(hex(lag(o_orderkey) OVER (ORDER BY o_orderkey))) AS previous_id,
       lower(hex(lead(o_orderkey) OVER (ORDER BY o_orderkey))) AS next_id,
       lead(o_orderkey) OVER (ORDER BY o_orderkey) IS NULL AS at_end FROM orders""",
)
def _(spark, sf):
    commits = frames.table(spark, sf, "orders").select(
        F.lower(F.hex("o_orderkey")).alias("version_id"), F.col("o_orderkey").alias("version_order")
    )
    return ordering.version_neighbors(commits)


@query(
    "measure_files",
    """SELECT doc_id, version_id, module, relative_path, CAST(lines AS BIGINT) AS lines, line_category_id FROM x_doc_cat
       WHERE line_category_id IS NOT NULL""",
)
def _(spark, sf):
    files = frames.document_files(spark, sf).withColumn("lines", line_count("content")).drop("content")
    return measures.measure_files(files)


