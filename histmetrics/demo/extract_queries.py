"""Extractors over source texts that Spark writes from table rows."""

from pyspark.sql import functions as F

from histmetrics.demo import frames
from histmetrics.demo.registry import query
from histmetrics.extract import classes, complexity, references
from histmetrics.operators import graph
from histmetrics.plans.analysis import analyze_files, select_files
from histmetrics.session import scratch_path, stored
from histmetrics.sources.store import HistoryStore
from histmetrics.streaming.incremental import analyze_pending

_PATH = """concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
    CAST(round(l_extendedprice * 100) AS BIGINT))"""
_XML = f"""(SELECT version_id, source, target, l_partkey % 200 AS k, l_returnflag = 'R' AS broken,
    CASE WHEN l_linestatus = 'F' THEN 'security/' ELSE 'views/' END || 'line_' || {_PATH} || '.xml' AS file_path,
    l_linestatus FROM x_ship)"""


@query(
    "xml_reference_facts",
    f"""SELECT version_id, source, target, 'security_ir_rule_model_ref' AS kind, file_path, 3 AS line,
        'ir.rule model_id -> ' || target || '.model_' || k AS detail FROM {_XML} WHERE NOT broken
        UNION ALL SELECT version_id, source, target, 'security_ir_rule_ref', file_path, 3, 'ref -> ' || target || '.model_' || k FROM {_XML} WHERE NOT broken
        UNION ALL SELECT version_id, source, target, 'security_ir_rule_ref', file_path, 4, 'ref -> ' || target || '.group_' || k FROM {_XML} WHERE NOT broken
        UNION ALL SELECT version_id, source, target, 'xml_inherit_id', file_path, 7, 'inherit_id -> ' || target || '.view_' || k FROM {_XML} WHERE NOT broken
        UNION ALL SELECT version_id, source, target, 'xml_percent_ref', file_path, 8, '%(' || target || '.action_' || k || ')d' FROM {_XML}
        UNION ALL SELECT version_id, source, target, CASE WHEN l_linestatus = 'F' THEN 'security_xml_ref' ELSE 'xml_ref' END, file_path, 9,
        'ref -> ' || target || '.menu_' || k FROM {_XML} WHERE NOT broken""",
)
def _(spark, sf):
    return references.xml_reference_facts(frames.xml_files(spark, sf))


@query(
    "xml_failures",
    f"""SELECT version_id, source || '/' || file_path AS file_path, 'no element found: line 11, column 0' AS error_text
        FROM {_XML} WHERE broken""",
)
def _(spark, sf):
    return references.xml_failures(frames.xml_files(spark, sf))


@query(
    "csv_reference_facts",
    f"""SELECT version_id, source, target, 'security_csv_ref' AS kind, 'security/line_' || {_PATH} || '.csv' AS file_path,
        CAST(line AS INTEGER) AS line, 'security csv ref -> ' || target || part || CAST(l_partkey % 200 AS VARCHAR) AS detail
        FROM x_ship JOIN (SELECT range AS line FROM range(2, 9)) ON line < l_linenumber + 2,
        (VALUES ('.model_'), ('.group_')) t(part)""",
)
def _(spark, sf):
    return references.csv_reference_facts(frames.csv_files(spark, sf))


@query(
    "manifest_depends",
    """SELECT 'cust_' || CAST(c_custkey AS VARCHAR) AS module, CASE WHEN c_custkey % 4 < 2 THEN lower(c_mktsegment)
       || ',nation_' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS depends,
       CASE c_custkey % 4 WHEN 2 THEN 'no_manifest_assignment' WHEN 3 THEN 'literal_eval_failed' END AS reason FROM customer""",
)
def _(spark, sf):
    found = references.manifests(frames.manifest_files(spark, sf))
    return found.select("module", F.array_join("depends", ",").alias("depends"), "reason")


# Syntax nodes per line of the generated texts: two for ``if a:``, three for
# ``a = 1``, and these for the lines around them.
_PY = f"""(SELECT {_PATH} AS key, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR)
    AS version_id, replace(p_brand, '#', '_') AS module, CASE WHEN l_linenumber = 7 THEN 'tests/' ELSE 'models/' END || 'line_' || {_PATH} || '.py'
    AS relative_path, CAST(l_quantity AS BIGINT) AS q, l_returnflag = 'R' AND l_linestatus = 'O' AS broken
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 7)"""
_GOOD = f"(SELECT * FROM {_PY} WHERE NOT broken)"
_CYCLOMATIC = f"SELECT version_id, module, relative_path, 'cyclomatic' AS family, CAST(unnest([q + 1, 4, 1, 2]) AS DOUBLE) AS value FROM {_GOOD}"
_COGNITIVE = f"SELECT version_id, module, relative_path, 'cognitive', CAST(unnest([q, 4, 2]) AS DOUBLE) FROM {_GOOD}"
_FIXED = "[1, 3, 2, 3, 3, 4, 1, 2, 1, 2, 5, 2]"
_JONES = f"""SELECT version_id, module, relative_path, 'jones' AS family, CAST(unnest(list_concat({_FIXED},
    list_concat([2 FOR i IN range(q)], [3 FOR i IN range(q)]))) AS DOUBLE) AS value FROM {_GOOD}"""
_VALUES = f"({_CYCLOMATIC} UNION ALL {_COGNITIVE} UNION ALL {_JONES})"
_P95 = "list_sort(list(value))[greatest(1, CAST(ceil(CAST(0.95 AS DOUBLE) * count(*)) AS BIGINT))]"


@query(
    "function_complexity",
    f"SELECT version_id, module, relative_path, family, value, count(*) AS n FROM {_VALUES} GROUP BY ALL",
)
def _(spark, sf):
    return complexity.function_complexity(frames.python_files(spark, sf))


@query(
    "python_file_distributions",
    f"""SELECT version_id, module, relative_path, family, count(*) AS count, avg(value) AS mean, median(value) AS median,
        {_P95} AS p95, max(value) AS max FROM {_VALUES} GROUP BY ALL""",
)
def _(spark, sf):
    return complexity.python_file_distributions(frames.python_files(spark, sf))


@query(
    "python_module_distributions",
    f"""SELECT version_id, module, family, count(*) AS count, avg(value) AS mean, median(value) AS median,
        {_P95} AS p95, max(value) AS max FROM {_VALUES} GROUP BY ALL""",
)
def _(spark, sf):
    return complexity.python_module_distributions(frames.python_files(spark, sf))


@query(
    "line_density",
    f"""SELECT version_id, module, relative_path, CAST(count(*) AS BIGINT) AS lines, CAST(sum(value) AS BIGINT) AS nodes
        FROM ({_JONES}) GROUP BY ALL""",
)
def _(spark, sf):
    lines = complexity.line_density(frames.python_files(spark, sf))
    return lines.groupBy("version_id", "module", "relative_path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("value").alias("nodes")
    )


@query(
    "failures",
    f"""SELECT version_id, module || '/' || relative_path AS file_path,
        'invalid syntax (' || split_part(relative_path, '/', 2) || ', line 1)' AS error_text FROM {_PY} WHERE broken""",
)
def _(spark, sf):
    return complexity.failures(frames.python_files(spark, sf))


# --- model classes -----------------------------------------------------------------------

_SELLERS = "(SELECT DISTINCT version_id, target, s_nationkey FROM x_ship)"
_NEXT = f"(SELECT version_id, target AS module, s_nationkey AS nk FROM {_SELLERS})"


@query(
    "python_class_facts",
    """SELECT fact, CAST(count(*) AS BIGINT) AS n FROM (
       SELECT unnest(['declared', 'python_many2one', 'python_related', 'method']) AS fact FROM (SELECT DISTINCT version_id, target FROM x_ship)
       UNION ALL SELECT unnest(['inherited', 'method', 'python_api_depends', 'env', 'call', 'env', 'call', 'call', 'access', 'call', 'call'])
       FROM x_ship) GROUP BY ALL""",
)
def _(spark, sf):
    facts = classes.python_class_facts(frames.class_files(spark, sf))
    return facts.groupBy("fact").agg(F.count(F.lit(1)).alias("n"))


@query(
    "python_links",
    f"""SELECT version_id, source, target, kind, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT version_id, source, target, unnest(['python_env_model', 'python_env_model', 'python_method_call', 'python_field_property_access']) AS kind FROM x_ship
        UNION ALL SELECT u.version_id, u.source, p.module, 'python_method_call' FROM x_ship u JOIN {_NEXT} p
          ON p.version_id = u.version_id AND p.nk = (u.s_nationkey + 1) % 25
        UNION ALL SELECT u.version_id, u.source, p.module, 'python_api_depends' FROM x_ship u JOIN {_NEXT} o
          ON o.version_id = u.version_id AND o.nk = u.c_nationkey JOIN {_NEXT} p
          ON p.version_id = u.version_id AND p.nk = (u.c_nationkey + 1) % 25
        UNION ALL SELECT s.version_id, s.target, p.module, unnest(['python_many2one', 'python_related']) FROM {_SELLERS} s JOIN {_NEXT} p
          ON p.version_id = s.version_id AND p.nk = (s.s_nationkey + 1) % 25)
        WHERE source <> target GROUP BY ALL""",
)
def _(spark, sf):
    files = frames.class_files(spark, sf)
    modules = files.select("version_id", "module").distinct()
    links = classes.python_links(files, modules)
    return links.groupBy("version_id", "source", "target", "kind").agg(F.sum("n").cast("long").alias("n"))


@query(
    "resolve_chains",
    f"""SELECT version_id, model, member, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT version_id, 'res.n' || CAST(s_nationkey AS VARCHAR) AS model, unnest(['ship', 'search', 'next_id']) AS member FROM x_ship
        UNION ALL SELECT u.version_id, 'res.n' || CAST(coalesce(p.nk + 1, u.s_nationkey) % 25 AS VARCHAR), 'ship' FROM x_ship u LEFT JOIN {_NEXT} p
          ON p.version_id = u.version_id AND p.nk = u.s_nationkey
        UNION ALL SELECT version_id, 'res.n' || CAST(c_nationkey AS VARCHAR), unnest(['sudo', '_hidden']) FROM x_ship) GROUP BY ALL""",
)
def _(spark, sf):
    facts = classes.python_class_facts(frames.class_files(spark, sf))
    fields = graph.model_fields(classes.own_fields(facts), classes.class_models(facts))
    uses = facts.where(F.col("fact").isin("call", "access"))
    return classes.resolve_chains(uses, fields).groupBy("version_id", "model", "member").agg(F.count(F.lit(1)).alias("n"))


# --- files to stored history -----------------------------------------------------------------


@query(
    "analyze_files",
    f"""SELECT version_id, files, modules, coalesce(edges, 0) AS edges, coalesce(points, 0) AS points, coalesce(failed, 0) AS failed FROM
        (SELECT version_id, count(DISTINCT source || '/' || file_path) AS files, count(DISTINCT source) AS modules,
           CAST(count(*) FILTER (broken) AS BIGINT) AS failed FROM {_XML} GROUP BY ALL)
        LEFT JOIN (SELECT version_id, count(DISTINCT source || ' ' || target) AS edges, count(DISTINCT source || ' ' || target || ' ' || kind) AS points FROM (
          SELECT version_id, source, target, unnest(['xml_percent_ref', 'security_ir_rule_model_ref', 'security_ir_rule_ref', 'xml_inherit_id',
            CASE WHEN l_linestatus = 'F' THEN 'security_xml_ref' ELSE 'xml_ref' END]) AS kind FROM {_XML} WHERE NOT broken
          UNION ALL SELECT version_id, source, target, 'xml_percent_ref' FROM {_XML} WHERE broken) f
          WHERE source <> target AND EXISTS (SELECT 1 FROM {_XML} m WHERE m.version_id = f.version_id AND m.source = f.target)
          GROUP BY ALL) USING (version_id)""",
)
def _(spark, sf):
    """XML files of all versions, analysed and stored as new versions; counted from the store."""
    store = HistoryStore(spark, scratch_path(spark, "analysis"))
    files = frames.xml_files(spark, sf, frames.stored_shipments(spark, sf))

    def measure(wanted):
        return analyze_files(files.join(wanted.select("version_id"), "version_id", "left_semi"))

    analyze_pending(store, frames.versions(spark, sf), measure)

    def tally(table, *aggregates):
        return store.read(table).groupBy("version_id").agg(*aggregates)

    out = tally("file_metric", F.count(F.lit(1)).alias("files"))
    for part in (
        tally("module_aggregate", F.count(F.lit(1)).alias("modules")),
        tally("coupling_edge", F.count(F.lit(1)).alias("edges"), F.sum("kind_occurrence_count").alias("points")),
        tally("failure", F.count(F.lit(1)).alias("failed")),
    ):
        out = out.join(part, "version_id", "left")
    return out.na.fill(0)


_SCOPE = f"(SELECT DISTINCT version_id, source FROM {_XML} WHERE source LIKE 'NATION_1%')"


@query(
    "analyze_project",
    f"""SELECT version_id, files, modules, python, coalesce(edges, 0) AS edges, coalesce(points, 0) AS points, failed, skipped FROM
        (SELECT version_id, 2 * count(*) + count(DISTINCT source) + max(sellers) AS files, count(DISTINCT source) AS modules,
           CAST(count(*) + max(sellers) AS DOUBLE) AS python, CAST(count(*) FILTER (broken) AS BIGINT) AS failed,
           count(DISTINCT source) FILTER (CAST(split_part(source, '_', 2) AS INTEGER) % 2 = 0) AS skipped
         FROM {_XML} JOIN (SELECT version_id, count(*) AS sellers FROM (SELECT DISTINCT x.version_id, target FROM {_XML} x JOIN {_SCOPE} s
           ON s.version_id = x.version_id AND s.source = x.target) GROUP BY ALL) USING (version_id)
         WHERE source LIKE 'NATION_1%' GROUP BY ALL)
        LEFT JOIN (SELECT version_id, count(DISTINCT source || ' ' || target) AS edges, count(DISTINCT source || ' ' || target || ' ' || kind) AS points FROM (
          SELECT version_id, source, target, unnest(['xml_percent_ref', 'security_ir_rule_model_ref', 'security_ir_rule_ref', 'xml_inherit_id', 'security_csv_ref',
            CASE WHEN l_linestatus = 'F' THEN 'security_xml_ref' ELSE 'xml_ref' END]) AS kind FROM {_XML} WHERE NOT broken
          UNION ALL SELECT version_id, source, target, unnest(['xml_percent_ref', 'security_csv_ref']) FROM {_XML} WHERE broken
          UNION ALL SELECT version_id, source, 'NATION_' || (CAST(split_part(source, '_', 2) AS INTEGER) + 1), 'manifest_depends' FROM {_SCOPE}) f
          WHERE source <> target AND (version_id, source) IN (SELECT (version_id, source) FROM {_SCOPE})
            AND (version_id, target) IN (SELECT (version_id, source) FROM {_SCOPE})
          GROUP BY ALL) USING (version_id)""",
)
def _(spark, sf):
    """Manifests, XML, CSV and Python files of two scan roots: scoped, without duplicate and stray files, analysed and stored."""
    columns = ("version_id", "module", "relative_path", "content")
    shipped = frames.stored_shipments(spark, sf)
    texts = [make(spark, sf, shipped) for make in (frames.xml_files, frames.csv_files, frames.class_files)]
    modules = stored(shipped.select("version_id", F.col("source").alias("module")).distinct(), "modules")
    number = F.substring_index("module", "_", -1).cast("int")
    depends = F.concat(F.lit("{'depends': ['NATION_"), (number + 1).cast("string"), F.lit("', 'gone']}"))
    manifests = modules.select("version_id", "module", F.lit("__manifest__.py").alias("relative_path"), depends.alias("content"))
    own = manifests
    for other in texts:
        own = own.unionByName(other.select(*columns))
    stray = modules.select("version_id", "module", F.lit("../elsewhere/x.xml").alias("relative_path"), F.lit("<a>").alias("content"))
    copies = manifests.where(number % 2 == 0)
    copies = copies.unionByName(copies.withColumns({"relative_path": F.lit("views/x.xml"), "content": F.lit("<a>")}))
    roots = (("addons", own.unionByName(stray)), ("vendor", copies))
    placed = [df.withColumn("path", F.concat(F.lit(f"{root}/"), "module")).withColumn("seq", F.lit(k)) for k, (root, df) in enumerate(roots)]
    files, skipped = select_files(placed[0].unionByName(placed[1]), prefixes=["NATION_1"])
    store = HistoryStore(spark, scratch_path(spark, "analysis"))

    def measure(wanted):
        return analyze_files(files.join(wanted.select("version_id"), "version_id", "left_semi"))

    analyze_pending(store, frames.versions(spark, sf), measure)

    def tally(df, *aggregates):
        return df.groupBy("version_id").agg(*aggregates)

    one = F.count(F.lit(1))
    out = tally(store.read("file_metric"), one.alias("files"))
    for part in (
        tally(store.read("module_aggregate"), one.alias("modules"), F.sum(F.col("metrics")["python_file_count"]).alias("python")),
        tally(store.read("coupling_edge"), one.alias("edges"), F.sum("kind_occurrence_count").alias("points")),
        tally(store.read("failure"), one.alias("failed")),
        tally(skipped, one.alias("skipped")),
    ):
        out = out.join(part, "version_id", "left")
    return out.na.fill(0)
