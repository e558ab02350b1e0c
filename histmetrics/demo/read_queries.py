"""Reads, rankings, series, differences and projections."""

from pyspark.sql import functions as F

from histmetrics.demo import frames
from histmetrics.demo.graph_queries import EDGE_SQL, flat_edges
from histmetrics.demo.registry import query
from histmetrics.functions.text import line_category
from histmetrics.functions.values import project_id
from histmetrics.operators import graph, measures
from histmetrics.plans import projections, reads, series

AT = "1998-Q2"
LATEST = "version_id = (SELECT version_id FROM x_latest)"


def modules_stored(spark, sf):
    """Module rows of the whole stored history."""
    return frames.history(spark, sf).read("module_aggregate")


def files_stored(spark, sf):
    return frames.history(spark, sf).read("file_metric")


def versions_stored(spark, sf):
    return frames.history(spark, sf).read("version")


@query(
    "project_info",
    """SELECT substr(sha256(r_name), 1, 16) AS project_id, r_name AS repo_path, 'main' AS branch,
       (SELECT count(*) FROM x_version) AS version_count FROM region ORDER BY r_name LIMIT 1""",
)
def _(spark, sf):
    project = frames.table(spark, sf, "region").orderBy("r_name").select(
        project_id("r_name").alias("project_id"), F.col("r_name").alias("repo_path"), F.lit("main").alias("branch")
    )
    return reads.project_info(project, frames.versions(spark, sf))


@query(
    "timeline",
    """SELECT version_id, version_order, strftime(authored_at, '%Y-%m-%d') AS authored, summary FROM x_version""",
)
def _(spark, sf):
    rows = reads.timeline(frames.versions(spark, sf))
    return rows.select("version_id", "version_order", F.date_format("authored_at", "yyyy-MM-dd").alias("authored"), "summary")


@query("latest_version", "SELECT version_id FROM x_latest")
def _(spark, sf):
    return reads.latest_version(frames.versions(spark, sf))


@query(
    "resolve_version",
    f"""SELECT 'id' AS how, '{AT}' AS version_id, (SELECT count(*) FROM x_line WHERE version_id = '{AT}') AS lines
        UNION ALL SELECT 'order', version_id, (SELECT count(*) FROM x_line WHERE version_order = 7985)
        FROM x_version WHERE version_order = 7985
        UNION ALL SELECT 'latest', version_id, (SELECT count(*) FROM x_line WHERE {LATEST}) FROM x_latest""",
)
def _(spark, sf):
    versions, lines = frames.versions(spark, sf), frames.lines(spark, sf)

    def one(how, selector):
        here = reads.resolve_version(versions, selector).select(F.lit(how).alias("how"), "version_id")
        return here.withColumn("lines", reads.at_version(lines, versions, selector).agg(F.count(F.lit(1))).scalar())

    return one("id", AT).unionByName(one("order", 7985)).unionByName(one("latest", None))


@query(
    "module_snapshot",
    f"""SELECT version_id, module, total_lines, css_lines, cyclomatic_mean, jones_p95, cognitive_count FROM x_module
        WHERE version_id = '{AT}'""",
)
def _(spark, sf):
    rows = reads.module_snapshot(modules_stored(spark, sf), versions_stored(spark, sf), AT)
    return rows.select(
        "version_id", "module", "total_lines", F.col("line_counts")["css_lines"].alias("css_lines"),
        F.col("metrics")["cyclomatic_mean"].alias("cyclomatic_mean"),
        F.col("metrics")["jones_p95"].alias("jones_p95"),
        F.col("distributions")["cognitive"]["count"].alias("cognitive_count"),
    )


@query(
    "file_snapshot",
    f"""SELECT version_id, module, relative_path, line_category_id, lines, cognitive_max FROM x_file
        WHERE {LATEST} AND module = 'Brand_7'""",
)
def _(spark, sf):
    rows = reads.file_snapshot(
        files_stored(spark, sf), versions_stored(spark, sf), None, "Brand_7"
    )
    return rows.select(
        "version_id", "module", "relative_path", "line_category_id", F.col("line_counts")["lines"].alias("lines"),
        F.col("metrics")["cognitive_max"].alias("cognitive_max"),
    )


@query(
    "graph_nodes",
    f"SELECT version_id, module, total_lines, jones_mean, xml_lines FROM x_module WHERE version_id = '{AT}'",
)
def _(spark, sf):
    rows = reads.graph_nodes(modules_stored(spark, sf), versions_stored(spark, sf), AT)
    return rows.select(
        "version_id", "module", "total_lines", F.col("metrics")["jones_mean"].alias("jones_mean"),
        F.col("line_counts")["xml_lines"].alias("xml_lines"),
    )


@query("graph_edges", f"SELECT {EDGE_SQL} FROM x_edge WHERE {LATEST} AND score > 0")
def _(spark, sf):
    return flat_edges(reads.graph_edges(frames.edges(spark, sf), frames.versions(spark, sf)))


@query(
    "graph_edges_with_zero",
    f"SELECT version_id, source, target, score, occurrences FROM x_strict_edge WHERE {LATEST}",
)
def _(spark, sf):
    edges = reads.graph_edges(frames.edges(spark, sf, strict=True), frames.versions(spark, sf), include_zero=True)
    return flat_edges(edges).select("version_id", "source", "target", "score", "occurrences")


@query(
    "relations",
    f"""SELECT source || '->' || target || ':' AS row_id, source AS source_id, source AS source_label, target AS target_id,
        target AS target_label, '' AS relation_type_id, '' AS relation_type_label, '' AS strength_metric_id,
        '' AS strength_metric_label, CAST(score AS DOUBLE) AS strength_value, version_id
        FROM x_strict_edge WHERE version_id = '{AT}' AND score > 0""",
)
def _(spark, sf):
    return reads.relations(frames.edges(spark, sf, strict=True), frames.versions(spark, sf), AT)


@query("edges_ranked", "SELECT version_id, source, target, score FROM x_edge")
def _(spark, sf):
    ranked = reads.edges_ranked(frames.edges(spark, sf))
    return ranked.select("version_id", "source", "target", F.col("score").cast("long").alias("score"))


@query(
    "entities",
    f"""SELECT id, 'python.file' AS kind, id AS label, relative_path AS path FROM (SELECT DISTINCT
        module || '/' || relative_path AS id, relative_path FROM x_line WHERE version_id = '{AT}')""",
)
def _(spark, sf):
    here = reads.at_version(frames.lines(spark, sf), frames.versions(spark, sf), AT)
    return reads.entities(here, "python.file")


@query("module_entities", "SELECT DISTINCT module AS id, 'python.module' AS kind, module AS label, module AS path FROM x_line")
def _(spark, sf):
    return reads.entities(frames.lines(spark, sf), "python.module")


@query(
    "scope_modules",
    """SELECT DISTINCT version_id, module FROM x_line WHERE module LIKE 'Brand\\_1%' ESCAPE '\\' OR module = 'Brand_7'""",
)
def _(spark, sf):
    return reads.scope_modules(frames.modules(spark, sf), ["Brand_1", "Brand_1"], ["Brand_7"])


@query(
    "within_root",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/srv/tree/' || k WHEN 1 THEN '/' || k WHEN 2 THEN '/srv/tree/b/' || k
       ELSE '/srv/other/' || k END AS resolved, page_id % 2 = 0 AS inside
       FROM (SELECT page_id, regexp_replace(split_part(url, '/', 3), '[^a-z.]', '', 'g') AS k FROM pages)""",
)
def _(spark, sf):
    name = F.regexp_replace(F.split("url", "/")[2], "[^a-z.]", "")
    case = F.col("page_id") % 4
    path = (
        F.when(case == 0, F.concat(F.lit("/srv/tree//./"), name))
        .when(case == 1, F.concat(F.lit("/"), name))
        .when(case == 2, F.concat(F.lit("a/../b/"), name))
        .otherwise(F.concat(F.lit("../other/x/../"), name))
    )
    pages = frames.table(spark, sf, "pages").select("page_id", path.alias("path"))
    return reads.within_root(pages, "/srv/tree").drop("path")


@query(
    "limit_with_flag",
    """SELECT version_id, source, target, score, row_number() OVER (ORDER BY score DESC, version_id, source, target) AS row_number,
       (SELECT count(*) FROM x_edge) > 25 AS truncated FROM x_edge ORDER BY score DESC, version_id, source, target LIMIT 25""",
)
def _(spark, sf):
    edges = frames.edges(spark, sf).select("version_id", "source", "target", F.col("score").cast("long").alias("score"))
    return reads.limit_with_flag(edges, 25, [F.desc("score"), "version_id", "source", "target"])


@query(
    "filter_categories",
    """SELECT doc_id, line_category_id FROM x_doc_cat WHERE line_category_id IN ('css_lines', 'python_test_lines')""",
)
def _(spark, sf):
    docs = frames.document_files(spark, sf).select("doc_id", line_category("relative_path").alias("line_category_id"))
    return reads.filter_categories(docs, ["css_lines", "python_test_lines"])


@query(
    "module_timeseries",
    """SELECT version_order, version_id, cyclomatic_p95 AS value FROM x_module JOIN x_version USING (version_id)
       WHERE module = 'Brand_2'""",
)
def _(spark, sf):
    return series.module_timeseries(
        modules_stored(spark, sf), versions_stored(spark, sf), "Brand_2", "cyclomatic", "p95"
    )


@query(
    "file_timeseries",
    """SELECT version_order, version_id, cognitive_median AS value FROM x_file JOIN x_version USING (version_id)
       WHERE module = 'Brand_2' AND relative_path = (SELECT min(relative_path) FROM x_file WHERE module = 'Brand_2')""",
)
def _(spark, sf):
    path = files_stored(spark, sf).where("module = 'Brand_2'").agg(F.min("relative_path").alias("p")).first()["p"]
    return series.file_timeseries(
        files_stored(spark, sf), versions_stored(spark, sf), "Brand_2", path, "cognitive", "median"
    )


@query(
    "latest_snapshot",
    f"SELECT module, total_lines, cyclomatic_median FROM x_module WHERE {LATEST}",
)
def _(spark, sf):
    rows = reads.latest_snapshot(modules_stored(spark, sf), versions_stored(spark, sf), ["module", "total_lines", "metrics"])
    return rows.select("module", "total_lines", F.col("metrics")["cyclomatic_median"].alias("cyclomatic_median"))


@query(
    "hotspots",
    f"""SELECT module AS name, cognitive_p95 AS current, CAST(NULL AS DOUBLE) AS first, CAST(NULL AS DOUBLE) AS growth
        FROM x_module WHERE {LATEST} ORDER BY current DESC, name LIMIT 20""",
)
def _(spark, sf):
    return reads.hotspots(modules_stored(spark, sf), versions_stored(spark, sf), "cognitive", "p95")


@query(
    "file_hotspots",
    f"""SELECT module || '/' || relative_path AS name, cyclomatic_mean AS current, CAST(NULL AS DOUBLE) AS first,
        CAST(NULL AS DOUBLE) AS growth FROM x_file WHERE {LATEST} ORDER BY current DESC, name LIMIT 20""",
)
def _(spark, sf):
    return reads.hotspots(files_stored(spark, sf), versions_stored(spark, sf), "cyclomatic_mean", "mean", "file")


@query(
    "growth_hotspots",
    """SELECT module AS name, current, first, current - first AS growth FROM (SELECT module,
       max_by(jones_mean, version_order) AS current, min_by(jones_mean, version_order) AS first,
       max(version_order) AS last FROM x_module JOIN x_version USING (version_id) GROUP BY module)
       WHERE last = (SELECT max(version_order) FROM x_version) ORDER BY growth DESC, name LIMIT 20""",
)
def _(spark, sf):
    return reads.hotspots(frames.module_aggregate(spark, sf), frames.versions(spark, sf), "jones", "mean", by="growth")


@query(
    "structure_timeseries",
    """SELECT version_order, version_id, CAST(coalesce(count(score), 0) AS BIGINT) AS edge_count,
       CAST(coalesce(sum(score), 0) AS BIGINT) AS total_score FROM x_version LEFT JOIN
       (SELECT * FROM x_strict_edge WHERE score > 0) USING (version_id) GROUP BY ALL""",
)
def _(spark, sf):
    return series.structure_timeseries(frames.edges(spark, sf, strict=True), frames.versions(spark, sf))


@query(
    "lines_by_category_series",
    """SELECT module, category, version_order, version_id, lines FROM (UNPIVOT (SELECT version_id, module, python_lines,
       js_lines, python_test_lines, xml_lines, css_lines, html_lines FROM x_lines_m) ON python_lines, js_lines,
       python_test_lines, xml_lines, css_lines, html_lines INTO NAME category VALUE lines) JOIN x_version USING (version_id)""",
)
def _(spark, sf):
    modules = measures.line_count_map(frames.module_line_counts(spark, sf))
    return series.lines_by_category_series(modules, frames.versions(spark, sf))


@query(
    "scalar_series",
    "SELECT module, version_order, version_id, CAST(total_lines AS DOUBLE) AS value FROM x_lines_m JOIN x_version USING (version_id)",
)
def _(spark, sf):
    modules = measures.line_count_map(frames.module_line_counts(spark, sf))
    return series.scalar_series(modules, frames.versions(spark, sf), "lines")


@query(
    "edge_kind_series",
    "SELECT kind, version_order, version_id, CAST(sum(n) AS BIGINT) AS occurrences FROM x_kind JOIN x_version USING (version_id) GROUP BY ALL",
)
def _(spark, sf):
    return series.edge_kind_series(frames.edges(spark, sf), frames.versions(spark, sf))


@query(
    "relations_diff",
    """SELECT source, target, CASE WHEN a IS NULL THEN 'added' ELSE 'removed' END AS change, a AS score_a, b AS score_b FROM
       (SELECT source, target, score AS a FROM x_strict_edge WHERE version_id = '1998-Q2' AND score > 0) FULL JOIN
       (SELECT source, target, score AS b FROM x_strict_edge WHERE version_id = '2000-Q1' AND score > 0)
       USING (source, target) WHERE a IS NULL OR b IS NULL""",
)
def _(spark, sf):
    changes = series.relations_diff(frames.edges(spark, sf, strict=True), frames.versions(spark, sf), AT, "2000-Q1")
    return changes.select(
        "source", "target", "change", F.col("score_a").cast("long").alias("score_a"), F.col("score_b").cast("long").alias("score_b")
    )


@query(
    "edge_points",
    f"""SELECT source, target, grp AS category, points, why AS why_points, found IS NULL AS missing FROM
        (SELECT DISTINCT source, CASE WHEN l_partkey % 50 = 0 THEN 'NOWHERE' ELSE target END AS target FROM x_fact) LEFT JOIN
        (SELECT source, target, true AS found FROM x_edge WHERE version_id = '{AT}') USING (source, target) LEFT JOIN
        (SELECT source, target, grp, CAST(sum(n) AS BIGINT) AS points, string_agg(kind || '=' || CAST(n AS VARCHAR), ', '
         ORDER BY kind || '=' || CAST(n AS VARCHAR)) AS why FROM x_kind WHERE version_id = '{AT}' GROUP BY ALL)
        USING (source, target)""",
)
def _(spark, sf):
    s = frames.shipments(spark, sf).where(F.col("source") != F.col("target"))
    pairs = s.select("source", F.when(F.col("l_partkey") % 50 == 0, "NOWHERE").otherwise(F.col("target")).alias("target"))
    return series.edge_points(pairs, frames.edges(spark, sf), frames.versions(spark, sf), AT)


@query(
    "edge_evidence",
    f"""SELECT source, target, kind, 'orders/' || CAST(l_orderkey AS VARCHAR) AS file_path, CAST(l_linenumber AS INTEGER) AS line,
        'part ' || CAST(l_partkey AS VARCHAR) AS detail FROM x_fact WHERE version_id = '{AT}' AND (source, target) IN
        (SELECT (source, target) FROM x_strict_edge WHERE version_id = '{AT}' AND score > 0)""",
)
def _(spark, sf):
    return series.edge_evidence(
        frames.edge_facts(spark, sf), frames.edges(spark, sf, strict=True), frames.versions(spark, sf), AT
    )


def _failures(spark, sf):
    """Files with flag A and no discount, as failures."""
    bad = frames.lines(spark, sf).where((F.col("jones") == 0) & (F.col("line_category_id") == "js_lines"))
    return bad.select(
        F.lit("run").alias("run_id"), "version_id", F.concat_ws("/", "module", "relative_path").alias("file_path"),
        F.concat(F.lit("line "), F.col("lines").cast("string")).alias("error_text"),
    )


_FAILED = """(SELECT version_id, module || '/' || relative_path AS file_path, 'line ' || CAST(lines AS VARCHAR) AS error_text
    FROM x_line WHERE jones = 0 AND line_category_id = 'js_lines')"""


@query("failures_at", f"SELECT version_id, file_path, error_text FROM {_FAILED} WHERE version_id = '{AT}'")
def _(spark, sf):
    return reads.failures_at(_failures(spark, sf), frames.versions(spark, sf), AT)


@query(
    "module_models_at",
    f"""SELECT DISTINCT target AS module, CASE WHEN l_returnflag = 'R' THEN 'declared' ELSE 'inherited' END AS role,
        'part.k' || CAST(l_partkey AS VARCHAR) AS model FROM x_ship WHERE version_id = '{AT}' AND
        (l_returnflag <> 'R' OR (target, l_partkey) NOT IN (SELECT (target, l_partkey) FROM x_ship
        WHERE version_id = '{AT}' AND l_returnflag <> 'R'))""",
)
def _(spark, sf):
    classes = frames.shipments(spark, sf).select(
        "version_id", F.col("target").alias("module"), F.col("l_partkey").alias("class_name"),
        F.when(F.col("l_returnflag") == "R", "declared").otherwise("inherited").alias("role"),
        frames.model_name().alias("model"),
    )
    models = graph.module_models(classes, ["module", "class_name"])
    return reads.module_models_at(models, frames.versions(spark, sf), AT)


@query("depends_at", f"SELECT DISTINCT source AS module, target AS depends_on FROM x_ship WHERE version_id = '{AT}'")
def _(spark, sf):
    sold = frames.shipments(spark, sf).select(
        "version_id", F.col("source").alias("module"), F.array("target", F.lit("stranger")).alias("depends")
    )
    declared = sold.groupBy("version_id", "module").agg(F.flatten(F.collect_set("depends")).alias("depends"))
    return reads.depends_at(declared, frames.nation_modules(spark, sf), frames.versions(spark, sf), AT)


@query(
    "module_detail",
    f"""SELECT module, total_lines, {', '.join(f'{f}_{s}' for f in measures.FAMILIES for s in measures.STATS)},
        cyclomatic_count AS method_count, CAST(coalesce(i, 0) AS BIGINT) AS score_in, CAST(coalesce(o, 0) AS BIGINT) AS score_out,
        CAST(coalesce(e, 0) AS BIGINT) AS parse_error_count
        FROM (SELECT * FROM x_module WHERE version_id = '{AT}')
        LEFT JOIN (SELECT 'Brand_' || split_part(target, '_', 2) AS module, sum(score) AS i FROM x_edge WHERE version_id = '{AT}' GROUP BY ALL) USING (module)
        LEFT JOIN (SELECT 'Brand_' || split_part(source, '_', 2) AS module, sum(score) AS o FROM x_edge WHERE version_id = '{AT}' GROUP BY ALL) USING (module)
        LEFT JOIN (SELECT module, count(*) AS e FROM x_line WHERE version_id = '{AT}' AND jones = 0 GROUP BY ALL) USING (module)""",
)
def _(spark, sf):
    def brand(c):
        return F.concat(F.lit("Brand_"), F.substring_index(c, "_", -1))

    edges = frames.edges(spark, sf).withColumn("source", brand("source")).withColumn("target", brand("target"))
    errors = frames.lines(spark, sf).where(F.col("jones") == 0).groupBy("version_id", "module").agg(
        F.count(F.lit(1)).alias("parse_error_count")
    )
    return reads.module_detail(
        modules_stored(spark, sf), edges, versions_stored(spark, sf), measures.FAMILIES, AT, errors
    )


@query(
    "file_detail",
    f"""SELECT name, split_part(relative_path, '/', 1) AS top_folder, line_category_id, lines,
        {', '.join(f'{f}_{s}' for f in measures.FAMILIES for s in measures.STATS)}, parse_error FROM
        (SELECT *, module || '/' || relative_path AS name FROM x_file WHERE version_id = '{AT}') LEFT JOIN
        (SELECT file_path AS name, min(error_text) AS parse_error FROM {_FAILED} WHERE version_id = '{AT}' GROUP BY ALL) USING (name)""",
)
def _(spark, sf):
    return reads.file_detail(
        files_stored(spark, sf), versions_stored(spark, sf), measures.FAMILIES, AT, _failures(spark, sf)
    )


# --- projections ------------------------------------------------------------------------


@query(
    "graph_projection",
    "SELECT version_id, source || '->' || target AS id, source, target, first_kind AS relation_type_id, CAST(score AS DOUBLE) AS score FROM x_edge",
)
def _(spark, sf):
    return projections.graph_edge_projection(frames.edges(spark, sf), "version_id")


@query(
    "graph_node_projection",
    f"""SELECT module AS id, 'python.module' AS kind, family || '_' || unnest(['mean', 'median', 'p95', 'max']) AS metric_id,
        unnest([mean, median, p95, max]) AS value FROM x_dist_m WHERE version_id = '{AT}'
        UNION ALL SELECT module, 'python.module', 'python_file_count', CAST(python_file_count AS DOUBLE) FROM x_lines_m
        WHERE version_id = '{AT}'""",
)
def _(spark, sf):
    nodes = reads.graph_nodes(modules_stored(spark, sf), versions_stored(spark, sf), AT)
    rows = projections.graph_node_projection(nodes).select("id", "kind", F.explode("metrics").alias("m"))
    return rows.select("id", "kind", "m.metric_id", "m.value")


@query(
    "table_projection",
    """SELECT 'modules' AS "table", version_id, module AS row_id, module AS drilldown_key, total_lines AS cell FROM x_lines_m
       UNION ALL SELECT 'files', version_id, module || '/' || relative_path, NULL, CAST(sum(lines) AS BIGINT) FROM x_line GROUP BY ALL
       UNION ALL SELECT 'relations', version_id, source || '->' || target || ':', NULL, score FROM x_strict_edge WHERE version_id = '1998-Q2' AND score > 0""",
)
def _(spark, sf):
    modules = projections.table_projection(frames.module_line_counts(spark, sf), "modules")
    files = projections.table_projection(frames.file_lines(spark, sf), "files")
    related = projections.table_projection(
        reads.relations(frames.edges(spark, sf, strict=True), frames.versions(spark, sf), AT), "relations"
    )

    def pick(df, name, cell):
        return df.select(F.lit(name).alias("table"), "version_id", "row_id", "drilldown_key", F.col(cell).cast("long").alias("cell"))

    return (
        pick(modules, "modules", "total_lines")
        .unionByName(pick(files, "files", "lines"))
        .unionByName(pick(related, "relations", "strength_value"))
    )


@query(
    "map_columns",
    """SELECT key, count(*) AS rows FROM (UNPIVOT (SELECT python_lines, js_lines, python_test_lines, xml_lines, css_lines,
       html_lines FROM x_lines_m) ON COLUMNS(*) INTO NAME key VALUE v) WHERE v <> 0 GROUP BY ALL""",
)
def _(spark, sf):
    modules = measures.line_count_map(frames.module_line_counts(spark, sf))
    return projections.map_columns(modules, "line_counts", displayable=True)


@query(
    "widen_map",
    "SELECT version_id, module, cyclomatic_mean AS m_cyclomatic_mean, cognitive_p95 AS m_cognitive_p95, CAST(NULL AS DOUBLE) AS m_absent FROM x_module",
)
def _(spark, sf):
    rows = frames.module_aggregate(spark, sf).select("version_id", "module", "metrics")
    return projections.widen_map(rows, "metrics", ["cyclomatic_mean", "cognitive_p95", "absent"], "m_")


@query(
    "discovered_columns",
    """SELECT 'line_counts.' || k AS key, l AS label, k = 'lines' AS visible_by_default, (SELECT count(*) FROM x_file) AS rows
       FROM (VALUES ('lines', 'Total lines'), ('function_count', 'Function count'), ('jones_line_count', 'Jones measured lines')) t(k, l)
       UNION ALL SELECT 'metrics.' || f || '_' || a, fl || ' ' || al, true, (SELECT count(*) FROM x_file) FROM
       (VALUES ('cyclomatic', 'Cyclomatic complexity'), ('cognitive', 'Cognitive complexity'), ('jones', 'Jones complexity'))
       m(f, fl), (VALUES ('mean', 'Mean'), ('median', 'Median'), ('p95', 'P95'), ('max', 'Max')) g(a, al)""",
)
def _(spark, sf):
    return projections.discovered_columns(frames.file_metric(spark, sf))

