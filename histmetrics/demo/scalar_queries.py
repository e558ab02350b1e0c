"""Column functions and catalog dimensions."""

from pyspark.sql import functions as F

from histmetrics.demo import frames
from histmetrics.demo.registry import query
from histmetrics.functions import text, validate, values
from histmetrics.operators import graph
from histmetrics.plans import projections, series


@query(
    "metric_at",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value,
       CAST(NULL AS DOUBLE) AS absent FROM events""",
)
def _(spark, sf):
    return frames.table(spark, sf, "events").select(
        "event_id",
        values.metric_at("props", "k", json_text=True).alias("value"),
        values.metric_at("props", "nothing", json_text=True).alias("absent"),
    )


@query(
    "parse_json_columns",
    """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
       CASE WHEN event_id % 10 = 0 THEN 'not ' || props END AS raw FROM events""",
)
def _(spark, sf):
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("not "), F.col("props"))).otherwise(F.col("props"))
    parsed = values.parse_json_columns(
        frames.table(spark, sf, "events").select("event_id", broken.alias("metrics"))
    )
    return parsed.select("event_id", F.col("metrics")["k"].alias("k"), F.col("metrics_raw").alias("raw"))


@query(
    "metric_key",
    """SELECT DISTINCT p_name, CASE WHEN m LIKE '%\\_mean' ESCAPE '\\' THEN m ELSE m || '_mean' END AS key
       FROM (SELECT p_name, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '_mean' ELSE '' END AS m
       FROM part)""",
)
def _(spark, sf):
    tail = F.when(F.col("p_partkey") % 2 == 0, "_mean").otherwise("")
    name = F.concat(F.translate("p_name", " ", "_"), tail)
    return frames.table(spark, sf, "part").select("p_name", values.metric_key(name, "mean").alias("key")).distinct()


@query(
    "epoch_ts",
    """SELECT o_orderkey, o_orderdate AS ts, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders""",
)
def _(spark, sf):
    ts = values.epoch_ts(F.unix_timestamp("o_orderdate"))
    return frames.table(spark, sf, "orders").select(
        "o_orderkey", ts.cast("timestamp_ntz").alias("ts"), values.iso_ts(ts).alias("iso")
    )


@query(
    "format_ts",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS shown FROM events""",
)
def _(spark, sf):
    given = F.when(F.col("event_id") % 7 == 0, "no date").otherwise(F.col("ts").cast("string"))
    return frames.table(spark, sf, "events").select("event_id", values.format_ts(given).alias("shown"))


@query("line_category", "SELECT doc_id, line_category_id FROM x_doc_cat")
def _(spark, sf):
    return frames.document_files(spark, sf).select(
        "doc_id", text.line_category("relative_path").alias("line_category_id")
    )


@query("is_test_path", "SELECT doc_id, is_test FROM x_doc_cat")
def _(spark, sf):
    return frames.document_files(spark, sf).select("doc_id", text.is_test_path("relative_path").alias("is_test"))


@query("line_count", "SELECT doc_id, CAST(lines AS BIGINT) AS lines FROM x_doc_lines")
def _(spark, sf):
    return frames.document_files(spark, sf).select("doc_id", text.line_count("content").alias("lines"))


@query(
    "top_folder",
    """SELECT doc_id, CASE WHEN contains(relative_path, '/') THEN split_part(relative_path, '/', 1) ELSE '.' END
       AS folder FROM x_doc""",
)
def _(spark, sf):
    return frames.document_files(spark, sf).select("doc_id", text.top_folder("relative_path").alias("folder"))


@query(
    "split_entity_path",
    """SELECT DISTINCT name, CASE WHEN instr(name, '/') > 1 AND instr(name, '/') < length(name)
       THEN split_part(name, '/', 1) END AS module,
       CASE WHEN instr(name, '/') > 1 AND instr(name, '/') < length(name)
       THEN substr(name, instr(name, '/') + 1) END AS relative_path
       FROM (SELECT CASE doc_id % 4 WHEN 0 THEN module || '/' WHEN 1 THEN '/' || relative_path WHEN 2 THEN module
       ELSE module || '/' || relative_path END AS name FROM x_doc)""",
)
def _(spark, sf):
    docs = frames.document_files(spark, sf)
    case = F.col("doc_id") % 4
    name = (
        F.when(case == 0, F.concat("module", F.lit("/")))
        .when(case == 1, F.concat(F.lit("/"), F.col("relative_path")))
        .when(case == 2, F.col("module"))
        .otherwise(F.concat_ws("/", "module", "relative_path"))
    )
    parts = docs.select(name.alias("name")).withColumn("parts", text.split_entity_path("name"))
    return parts.select("name", "parts.module", "parts.relative_path").distinct()


@query(
    "external_ids",
    r"""SELECT page_id, CAST(pos AS INTEGER) AS pos, ids[pos] AS external_id FROM
       (SELECT page_id, ids, unnest(range(1, len(ids) + 1)) AS pos FROM
       (SELECT page_id, regexp_extract_all(url || ' ' || html, '([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)', 1) AS ids FROM pages))""",
)
def _(spark, sf):
    ids = text.external_ids(F.concat_ws(" ", "url", "html"))
    return frames.table(spark, sf, "pages").select("page_id", F.posexplode(ids).alias("at", "external_id")).select(
        "page_id", (F.col("at") + 1).alias("pos"), "external_id"
    )


@query(
    "id_module",
    r"""SELECT split_part(id, '.', 1) AS module, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text,
       '([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)', 1)) AS id FROM documents) GROUP BY ALL""",
)
def _(spark, sf):
    ids = frames.table(spark, sf, "documents").select(F.explode(text.external_ids("text")).alias("id"))
    return ids.groupBy(text.id_module("id").alias("module")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "valid_identifiers",
    r"""SELECT c_custkey,
       CASE WHEN regexp_matches(h, '^[0-9a-fA-F]+$') THEN h END AS hash,
       CASE WHEN regexp_matches(h, '^[0-9a-fA-F]{8,64}$') THEN h END AS run_id,
       CASE WHEN regexp_matches(m, '^[A-Za-z_][A-Za-z0-9_]*$') THEN m END AS module,
       CASE WHEN regexp_matches(d, '^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$') THEN d END AS model,
       CASE WHEN e NOT LIKE '% %' THEN e END AS email,
       CASE WHEN c_acctbal >= 0 OR CAST(trunc(c_acctbal) AS BIGINT) = 0 THEN CAST(trunc(c_acctbal) AS BIGINT) END AS epoch
       FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END || lower(hex(c_custkey * 99991)) AS h,
       CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS m,
       lower(c_mktsegment) || CASE WHEN c_custkey % 5 = 0 THEN '..x' ELSE '.x' || CAST(c_custkey AS VARCHAR) END AS d,
       c_name || CASE WHEN c_custkey % 4 = 0 THEN ' @x' ELSE '@x' END AS e FROM customer)""",
)
def _(spark, sf):
    key = F.col("c_custkey")
    given = frames.table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.when(key % 3 == 0, "x").otherwise(""), F.lower(F.hex(key * 99991))).alias("h"),
        F.when(key % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("m"),
        F.concat(
            F.lower("c_mktsegment"),
            F.when(key % 5 == 0, F.lit("..x")).otherwise(F.concat(F.lit(".x"), key.cast("string"))),
        ).alias("d"),
        F.concat("c_name", F.when(key % 4 == 0, " @x").otherwise("@x")).alias("e"),
        F.col("c_acctbal").cast("long").cast("string").alias("s"),
    )
    return given.select(
        "c_custkey",
        validate.valid_hash("h").alias("hash"),
        validate.valid_run_id("h").alias("run_id"),
        validate.valid_module("m").alias("module"),
        validate.valid_model("d").alias("model"),
        validate.valid_email("e").alias("email"),
        validate.valid_epoch("s").alias("epoch"),
    )


_LABELS = """CASE WHEN key LIKE 'cyclomatic%' THEN 'Cyclomatic complexity' WHEN key LIKE 'cognitive%'
    THEN 'Cognitive complexity' ELSE 'Jones complexity' END || CASE WHEN key LIKE '%mean' THEN ' Mean'
    WHEN key LIKE '%median' THEN ' Median' WHEN key LIKE '%p95' THEN ' P95' ELSE ' Max' END"""


@query(
    "metric_label",
    f"""SELECT key, {_LABELS} AS label, count(*) AS n FROM (SELECT family || '_' || unnest(['mean', 'median', 'p95', 'max'])
        AS key FROM x_dist_f) GROUP BY ALL UNION ALL
        SELECT category, CASE category WHEN 'python_lines' THEN 'Python Lines' WHEN 'js_lines' THEN 'Js Lines'
        WHEN 'python_test_lines' THEN 'Python Test Lines' WHEN 'xml_lines' THEN 'Xml Lines' WHEN 'css_lines'
        THEN 'Css Lines' ELSE 'Html Lines' END, count(*) FROM (SELECT line_category_id AS category FROM x_file)
        GROUP BY ALL""",
)
def _(spark, sf):
    files = frames.file_metric(spark, sf)
    keys = projections.map_columns(files, "metrics").withColumnRenamed("rows", "n")
    categories = files.groupBy(F.col("line_category_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keys.unionByName(categories).select("key", values.metric_label("key").alias("label"), "n")


@query(
    "fallback_label",
    """SELECT DISTINCT raw, CASE WHEN raw = '__' THEN '—' ELSE upper(split_part(p_name, ' ', 1)[1])
       || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' || upper(split_part(p_name, ' ', 2)[1])
       || lower(substr(split_part(p_name, ' ', 2), 2)) || ' ' || upper(p_type[1]) || lower(substr(p_type, 2)) END AS label,
       CASE WHEN raw = '__' THEN '' ELSE upper(p_name[1]) || substr(p_name, 2) || '.' || p_type END AS edge_label
       FROM (SELECT *, CASE WHEN p_size = 7 THEN '__' ELSE replace(p_name, ' ', '_') || '.' || p_type END AS raw FROM part)""",
)
def _(spark, sf):
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("."), F.col("p_type"))
    raw = F.when(F.col("p_size") == 7, F.lit("__")).otherwise(name)
    return frames.table(spark, sf, "part").select(raw.alias("raw")).distinct().select(
        "raw", values.fallback_label("raw").alias("label"), values.edge_label("raw").alias("edge_label")
    )


@query(
    "fmt_values",
    """SELECT o_orderkey, format('{:,}', o_orderkey * 1234) AS lines,
       CASE WHEN v >= 1000000 THEN regexp_replace(CAST(CAST((v * 10 + 500000) // 1000000 AS DECIMAL(28, 1)) / 10 AS VARCHAR), '[.]0$', '') || 'M'
       WHEN v >= 1000 THEN regexp_replace(CAST(CAST((v * 10 + 500) // 1000 AS DECIMAL(28, 1)) / 10 AS VARCHAR), '[.]0$', '') || 'k'
       ELSE CAST(v AS VARCHAR) END AS compact,
       printf('%.2f', o_orderkey / 4.0) AS metric,
       CASE WHEN o_orderkey >= 60 THEN CAST(o_orderkey // 60 AS VARCHAR) || 'm' ELSE '' END
       || CAST(o_orderkey % 60 AS VARCHAR) || 's' AS duration
       FROM (SELECT o_orderkey, o_orderkey * 1234 AS v FROM orders)""",
)
def _(spark, sf):
    key = F.col("o_orderkey")
    return frames.table(spark, sf, "orders").select(
        "o_orderkey",
        values.fmt_lines(key * 1234).alias("lines"),
        values.fmt_compact(key * 1234).alias("compact"),
        values.fmt_metric(key / 4).alias("metric"),
        values.fmt_duration(key).alias("duration"),
    )


@query(
    "version_label",
    """SELECT version_id, '#' || CAST(version_order AS VARCHAR) || ' ' || substr(version_id, 1, 8) || ' ' || summary
       AS label, '#' || CAST(version_order AS VARCHAR) || ' ' || substr(version_id, 1, 8) AS short FROM x_version""",
)
def _(spark, sf):
    return frames.versions(spark, sf).select(
        "version_id",
        values.version_label("version_order", "version_id", "summary").alias("label"),
        values.version_label("version_order", "version_id").alias("short"),
    )


@query("project_id", "SELECT page_id, substr(sha256(url), 1, 16) AS project_id FROM pages")
def _(spark, sf):
    return frames.table(spark, sf, "pages").select("page_id", values.project_id("url").alias("project_id"))


@query(
    "cell_at",
    """SELECT version_id, module, relative_path, format('{:,}', CAST(lines AS BIGINT)) AS lines,
       CASE WHEN jones_median = floor(jones_median) THEN format('{:,}', CAST(jones_median AS BIGINT))
       ELSE printf('%.2f', jones_median) END AS jones, '—' AS absent FROM x_file""",
)
def _(spark, sf):
    return frames.file_metric(spark, sf).select(
        "version_id",
        "module",
        "relative_path",
        values.cell_at("line_counts.lines").alias("lines"),
        values.cell_at("metrics.jones_median").alias("jones"),
        values.cell_at("metrics.nothing").alias("absent"),
    )


@query(
    "line_of",
    """SELECT doc_id, CASE WHEN instr(text, s) > 0 AND s <> '' THEN
       len(left(text, instr(text, s) - 1)) - len(replace(left(text, instr(text, s) - 1), chr(10), '')) + 1
       ELSE 0 END AS line, 0 AS absent FROM (SELECT doc_id, text, substr(text, length(text) // 2, 12) AS s FROM documents)""",
)
def _(spark, sf):
    docs = frames.table(spark, sf, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    snippet = F.substr("text", half, F.lit(12))
    return docs.select(
        "doc_id",
        text.line_of("text", snippet).cast("long").alias("line"),
        text.line_of("text", F.lit("no such snippet")).cast("int").alias("absent"),
    )


# --- catalogs, against what the data holds ---------------------------------------------


@query(
    "catalog_metrics",
    """SELECT metric_id, label, scope, CAST(coalesce(files, 0) AS BIGINT) AS files FROM (VALUES
       ('cyclomatic', 'Cyclomatic complexity', 'both'), ('cognitive', 'Cognitive complexity', 'both'),
       ('jones', 'Jones complexity', 'both'), ('python_file_count', 'Python file count', 'module'),
       ('lines', 'Total lines', 'both'), ('lines_by_category', 'Lines by category', 'module'),
       ('jones_line_count', 'Jones measured lines', 'file'), ('function_count', 'Function count', 'file'))
       t(metric_id, label, scope) LEFT JOIN (SELECT family, count(*) AS files FROM x_dist_f GROUP BY family)
       ON family = metric_id""",
)
def _(spark, sf):
    measured = (
        frames.file_metric(spark, sf)
        .select(F.explode(F.map_keys("distributions")).alias("metric_id"))
        .groupBy("metric_id")
        .agg(F.count(F.lit(1)).alias("files"))
    )
    return projections.catalog_metrics(spark).join(measured, "metric_id", "left").select(
        "metric_id", "label", "scope", F.coalesce("files", F.lit(0)).alias("files")
    )


@query(
    "catalog_relation_types",
    """SELECT id, label, default_enabled, CAST(coalesce(points, 0) AS BIGINT) AS points FROM (VALUES
       ('manifest_depends', 'Manifest depends on', true), ('model_reuse', 'Model reuse', true),
       ('extension_or_method', 'Extension / method', true), ('view', 'View', true),
       ('field_property', 'Field / property', true)) t(id, label, default_enabled)
       LEFT JOIN (SELECT grp, sum(n) AS points FROM x_kind GROUP BY grp) ON grp = id""",
)
def _(spark, sf):
    points = (
        graph.edge_breakdown(graph.kind_counts(frames.edge_facts(spark, sf)))
        .groupBy(F.col("group").alias("id"))
        .agg(F.sum("points").alias("points"))
    )
    return projections.catalog_options(spark, "relation_type").join(points, "id", "left").select(
        "id", "label", "default_enabled", F.coalesce("points", F.lit(0)).alias("points")
    )


@query(
    "catalog_line_categories",
    """SELECT id, stored_id, label, default_enabled, CAST(coalesce(n, 0) AS BIGINT) AS lines FROM (VALUES
       ('python_lines', 'python_lines', 'Python', true), ('css_lines', 'css_lines', 'CSS', false),
       ('html_lines', 'html_lines', 'HTML', false), ('js_lines', 'js_lines', 'JS', false),
       ('xml_lines', 'xml_lines', 'XML', false), ('test_lines', 'python_test_lines', 'Tests', true))
       t(id, stored_id, label, default_enabled)
       LEFT JOIN (SELECT line_category_id, sum(lines) AS n FROM x_line GROUP BY ALL) ON line_category_id = stored_id""",
)
def _(spark, sf):
    sums = frames.lines(spark, sf).groupBy(F.col("line_category_id").alias("stored_id")).agg(F.sum("lines").alias("n"))
    return projections.catalog_options(spark, "line_category").join(sums, "stored_id", "left").select(
        "id", "stored_id", "label", "default_enabled", F.coalesce("n", F.lit(0)).alias("lines")
    )


@query(
    "catalog_aggregations",
    """SELECT id, label, default_enabled, n FROM (VALUES ('mean', 'Mean', true), ('median', 'Median', true),
       ('p95', 'P95', false), ('max', 'Max', false)) t(id, label, default_enabled),
       (SELECT count(*) AS n FROM x_dist_m)""",
)
def _(spark, sf):
    keys = projections.map_columns(frames.module_aggregate(spark, sf), "metrics")
    stored = keys.groupBy(F.substring_index("key", "_", -1).alias("id")).agg(F.sum("rows").alias("n"))
    return projections.catalog_options(spark, "aggregation").join(stored, "id", "left")


@query(
    "catalog_graph_options",
    """SELECT control, id, label, default_enabled, CAST(CASE WHEN id = 'total_lines' THEN (SELECT sum(lines) FROM x_line)
       WHEN id IN ('score_in', 'score_out', 'score') THEN (SELECT count(*) FROM x_fact) END AS BIGINT) AS total
       FROM (VALUES
       ('node_size', 'total_lines', 'Total Lines', true), ('node_size', 'visible_lines', 'Visible Lines', false),
       ('node_size', 'method_count', 'Methods', false), ('node_size', 'score_in', 'Score In', false),
       ('node_size', 'score_out', 'Score Out', false), ('node_size', 'fixed', 'Fixed', false),
       ('link_thickness', 'score', 'Score', true), ('link_thickness', 'total_points', 'Total Points', false),
       ('link_thickness', 'selected_kind_points', 'Kind Points', false), ('link_thickness', 'fixed', 'Fixed', false))
       t(control, id, label, default_enabled)""",
)
def _(spark, sf):
    options = [
        projections.catalog_options(spark, kind).select(F.lit(kind).alias("control"), "id", "label", "default_enabled")
        for kind in ("node_size", "link_thickness")
    ]
    scores = graph.module_scores(frames.nation_modules(spark, sf), frames.edges(spark, sf))
    sums = scores.agg(F.sum("incoming_score").alias("score_in"), F.sum("outgoing_score").alias("score_out"))
    totals = sums.select(
        F.explode(F.create_map(F.lit("score_in"), "score_in", F.lit("score_out"), "score_out", F.lit("score"), "score_out"))
    ).unionByName(
        frames.lines(spark, sf).agg(F.sum("lines").alias("value")).select(F.lit("total_lines").alias("key"), "value")
    )
    return options[0].unionByName(options[1]).join(totals.withColumnsRenamed({"key": "id", "value": "total"}), "id", "left")


@query(
    "validate_requests",
    """SELECT event_id, metric, level, coalesce(a, 'mean') AS agg,
       CASE WHEN metric = 'value' THEN 'unavailable' WHEN metric = 'python_file_count' AND level = 'file' THEN 'unavailable'
       WHEN metric = 'function_count' AND level = 'module' THEN 'unavailable'
       WHEN coalesce(a, 'mean') = 'p50' THEN 'unavailable' ELSE 'valid' END AS status,
       CASE WHEN metric = 'value' THEN 'unknown_metric' WHEN metric = 'python_file_count' AND level = 'file'
       THEN 'module_scope_only' WHEN metric = 'function_count' AND level = 'module' THEN 'file_scope_only'
       WHEN coalesce(a, 'mean') = 'p50' THEN 'unknown_aggregation' END AS reason
       FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 'cyclomatic' WHEN 'view' THEN 'python_file_count'
       WHEN 'click' THEN 'function_count' WHEN 'purchase' THEN 'lines' ELSE 'value' END AS metric,
       CASE WHEN user_id % 2 = 0 THEN 'file' WHEN user_id % 3 = 0 THEN NULL ELSE 'module' END AS level,
       CASE event_id % 3 WHEN 0 THEN 'max' WHEN 1 THEN 'p50' END AS a FROM events)""",
)
def _(spark, sf):
    user, event = F.col("user_id"), F.col("event_id")
    requests = frames.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "signup", "cyclomatic")
        .when(F.col("event_type") == "view", "python_file_count")
        .when(F.col("event_type") == "click", "function_count")
        .when(F.col("event_type") == "purchase", "lines")
        .otherwise("value").alias("metric"),
        F.when(user % 2 == 0, "file").when(user % 3 == 0, F.lit(None)).otherwise("module").alias("level"),
        F.when(event % 3 == 0, "max").when(event % 3 == 1, "p50").alias("agg"),
    )
    return projections.validate_requests(requests)


@query(
    "column_catalog",
    """SELECT key, label, metric_id, CAST(coalesce(n, 0) AS BIGINT) AS rows FROM (
       SELECT 'metrics.' || f || '_' || a AS key, fl || ' ' || al AS label, f AS metric_id FROM
       (VALUES ('cyclomatic', 'Cyclomatic complexity'), ('cognitive', 'Cognitive complexity'), ('jones', 'Jones complexity'))
       m(f, fl), (VALUES ('mean', 'Mean'), ('median', 'Median'), ('p95', 'P95'), ('max', 'Max')) g(a, al)
       UNION ALL VALUES ('line_counts.lines', 'Total lines', 'lines'),
       ('line_counts.jones_line_count', 'Jones measured lines', 'jones_line_count'),
       ('line_counts.function_count', 'Function count', 'function_count')), (SELECT count(*) AS n FROM x_file)""",
)
def _(spark, sf):
    found = projections.discovered_columns(frames.file_metric(spark, sf)).select("key", "rows")
    return projections.column_catalog(spark).join(found, "key", "left").select(
        "key", "label", "metric_id", F.coalesce("rows", F.lit(0)).alias("rows")
    )


@query(
    "metric_value",
    """SELECT module, version_order, version_id, CAST(python_file_count AS DOUBLE) AS value
       FROM x_module JOIN x_version USING (version_id)""",
)
def _(spark, sf):
    return series.scalar_series(frames.module_aggregate(spark, sf), frames.versions(spark, sf), "python_file_count")
