"""Facts, edges, links and traversals."""

from pyspark.sql import functions as F

from histmetrics.demo import frames
from histmetrics.demo.registry import query
from histmetrics.demo.sql import _VERSION as VERSION_SQL
from histmetrics.functions.catalog import STRICT_KIND_GROUP
from histmetrics.functions.text import external_ids, id_module
from histmetrics.operators import graph, traversal
from histmetrics.session import cut_lineage, stored

EDGE_SQL = "version_id, source, target, score, occurrences, kinds, model_reuse, extension_or_method, view_points, field_property"


def flat_edges(df):
    """Edge rows with maps as scalars and as one sorted text."""
    listed = F.transform(F.sort_array(F.map_entries("kinds")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    part = {g: F.try_element_at("breakdown", F.lit(g)).cast("long") for g in ("model_reuse", "extension_or_method", "field_property")}
    return df.select(
        "version_id", "source", "target", F.col("score").cast("long").alias("score"),
        F.col("kind_occurrence_count").cast("long").alias("occurrences"),
        F.array_join(listed, ",").alias("kinds"),
        *[c.alias(g) for g, c in part.items()],
        F.try_element_at("breakdown", F.lit("view")).cast("long").alias("view_points"),
    )


def counts_as_facts(df):
    return df.select("version_id", "source", "target", "kind", F.col("n").cast("long").alias("n"))


@query("reduce_edge_facts", f"SELECT {EDGE_SQL} FROM x_edge")
def _(spark, sf):
    return flat_edges(graph.reduce_edge_facts(frames.edge_facts(spark, sf)))


@query("reduce_edge_facts_strict", "SELECT version_id, source, target, score, occurrences FROM x_strict_edge")
def _(spark, sf):
    edges = graph.reduce_edge_facts(frames.edge_facts(spark, sf), STRICT_KIND_GROUP)
    return flat_edges(edges).select("version_id", "source", "target", "score", "occurrences")


@query("edge_breakdown", "SELECT version_id, source, target, grp AS \"group\", CAST(sum(n) AS BIGINT) AS points FROM x_kind GROUP BY ALL")
def _(spark, sf):
    return graph.edge_breakdown(graph.kind_counts(frames.edge_facts(spark, sf)))


@query("edge_score", "SELECT version_id, source, target, score, occurrences FROM x_edge")
def _(spark, sf):
    return frames.edges(spark, sf).select(
        "version_id", "source", "target",
        graph.edge_score("breakdown").cast("long").alias("score"),
        graph.edge_score("kinds").cast("long").alias("occurrences"),
    )


@query("presence_facts", "SELECT DISTINCT version_id, source, target, kind FROM x_fact")
def _(spark, sf):
    noise = frames.edge_facts(spark, sf)
    bad = noise.withColumn("kind", F.lit("imports")).unionByName(noise.withColumn("target", F.lit("not a name")))
    return graph.presence_facts(noise.unionByName(bad), frames.nation_modules(spark, sf))


@query(
    "build_coupling_edges",
    """SELECT version_id, source, target, CAST(count(DISTINCT kind) AS BIGINT) AS score,
       CAST(count(DISTINCT kind) AS BIGINT) AS occurrences FROM x_fact GROUP BY ALL""",
)
def _(spark, sf):
    edges = graph.build_coupling_edges(frames.edge_facts(spark, sf), frames.nation_modules(spark, sf), "presence")
    return flat_edges(edges).select("version_id", "source", "target", "score", "occurrences")


@query("build_coupling_edges_occurrence", f"SELECT {EDGE_SQL} FROM x_edge")
def _(spark, sf):
    return flat_edges(
        graph.build_coupling_edges(frames.edge_facts(spark, sf), frames.nation_modules(spark, sf), "occurrence")
    )


@query(
    "module_scores",
    """SELECT version_id, module, CAST(coalesce(o, 0) AS BIGINT) AS outgoing_score, CAST(coalesce(i, 0) AS BIGINT) AS incoming_score
       FROM x_nation_module LEFT JOIN (SELECT version_id, source AS module, sum(score) AS o FROM x_edge GROUP BY ALL)
       USING (version_id, module) LEFT JOIN (SELECT version_id, target AS module, sum(score) AS i FROM x_edge GROUP BY ALL)
       USING (version_id, module)""",
)
def _(spark, sf):
    return graph.module_scores(frames.nation_modules(spark, sf), frames.edges(spark, sf))


@query(
    "edge_included",
    """SELECT version_id, score >= 1 AS shown, score >= 0 AS shown_with_zero, score >= 3 AS shown_from_three, count(*) AS edges
       FROM x_strict_edge GROUP BY ALL""",
)
def _(spark, sf):
    edges = frames.edges(spark, sf, strict=True)
    return edges.groupBy(
        "version_id",
        graph.edge_included().alias("shown"),
        graph.edge_included(include_zero=True).alias("shown_with_zero"),
        graph.edge_included(minimum=3).alias("shown_from_three"),
    ).agg(F.count(F.lit(1)).alias("edges"))


@query(
    "link_models",
    """SELECT u.version_id, u.module AS source, o.module AS target, 'python_env_model' AS kind, count(*) AS n
       FROM x_use u JOIN x_owner o USING (version_id, model) WHERE u.module <> o.module GROUP BY ALL""",
)
def _(spark, sf):
    return counts_as_facts(
        graph.link_models(frames.model_uses(spark, sf), frames.model_owners(spark, sf), frames.nation_modules(spark, sf))
    )


def _members(spark, sf):
    """Each owner provides ``ship`` and ``_ship`` of its models."""
    member = F.explode(F.array(F.lit("ship"), F.lit("_ship"))).alias("member")
    return frames.model_owners(spark, sf).select("version_id", "model", "module", member)


@query(
    "link_methods",
    """SELECT u.version_id, u.module AS source, o.module AS target, CASE WHEN member = '_ship' THEN
       'python_private_method_call' ELSE 'python_method_call' END AS kind, count(*) AS n
       FROM x_use u JOIN x_owner o USING (version_id, model) WHERE u.module <> o.module GROUP BY ALL""",
)
def _(spark, sf):
    return counts_as_facts(
        graph.link_methods(frames.model_uses(spark, sf), _members(spark, sf), frames.nation_modules(spark, sf))
    )


@query(
    "link_fields",
    """SELECT u.version_id, u.module AS source, o.module AS target, 'python_field_property_access' AS kind, count(*) AS n
       FROM x_use u JOIN x_owner o USING (version_id, model) WHERE u.module <> o.module AND member = 'ship' GROUP BY ALL""",
)
def _(spark, sf):
    provided = _members(spark, sf).where(F.col("member") == "ship")
    return counts_as_facts(graph.link_fields(frames.model_uses(spark, sf), provided, frames.nation_modules(spark, sf)))


@query(
    "resolve_paths",
    """SELECT version_id, module, class_name, 'f' || CAST(l_partkey % 3 AS VARCHAR) || '.code' AS path,
       'part.k' || CAST(max(l_partkey) AS VARCHAR) AS model FROM (SELECT version_id, source AS module,
       'c' || CAST(l_partkey % 40 AS VARCHAR) AS class_name, l_partkey FROM x_ship)
       WHERE l_partkey % 3 < 2 GROUP BY version_id, module, class_name, l_partkey % 3""",
)
def _(spark, sf):
    s = frames.shipments(spark, sf).select(
        "version_id", F.col("source").alias("module"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")).alias("class_name"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("field"),
        "l_partkey",
    )
    keys = ["version_id", "module", "class_name"]
    relational = s.where(F.col("field") != "f2").groupBy(*keys, "field").agg(
        F.concat(F.lit("part.k"), F.max("l_partkey").cast("string")).alias("comodel")
    )
    paths = s.select(*keys, F.concat("field", F.lit(".code")).alias("path")).distinct()
    return graph.resolve_paths(paths, relational, ["module", "class_name"])


def _manifests(spark, sf):
    """Declared dependencies: selling nations of each buyer, plus itself and a stranger."""
    sold = frames.shipments(spark, sf).select("version_id", F.col("source").alias("module"), "target").distinct()
    extra = F.array(F.col("target"), F.col("module"), F.lit("stranger"))
    return sold.select("version_id", "module", extra.alias("depends"))


@query(
    "link_manifests",
    """SELECT DISTINCT version_id, source, target, 'manifest_depends' AS kind, 'depends -> ' || target AS detail FROM x_fact""",
)
def _(spark, sf):
    facts = graph.link_manifests(_manifests(spark, sf), frames.nation_modules(spark, sf))
    return facts.select("version_id", "source", "target", "kind", "detail")


@query(
    "in_scope_depends",
    """SELECT version_id, module, string_agg(d, ',' ORDER BY d) AS depends FROM (
       SELECT DISTINCT version_id, source AS module, unnest([source, target]) AS d FROM x_ship) GROUP BY ALL""",
)
def _(spark, sf):
    declared = _manifests(spark, sf).groupBy("version_id", "module").agg(
        F.array_distinct(F.flatten(F.collect_set("depends"))).alias("depends")
    )
    rows = graph.in_scope_depends(declared, frames.nation_modules(spark, sf))
    return rows.select("version_id", "module", F.array_join("manifest_depends", ",").alias("depends"))


_CLASS = """(SELECT DISTINCT version_id, target AS module, 'c' || CAST(l_partkey % 50 AS VARCHAR) AS class_name,
    CASE WHEN l_returnflag = 'R' THEN 'declared' ELSE 'inherited' END AS role,
    'm.k' || CAST(l_partkey % 20 AS VARCHAR) AS model FROM x_ship)"""
_TARGET = f"""(SELECT version_id, module, class_name, model FROM {_CLASS} WHERE role = 'declared' UNION
    SELECT version_id, module, class_name, model FROM {_CLASS} WHERE role = 'inherited' AND (version_id, module, class_name)
    NOT IN (SELECT (version_id, module, class_name) FROM {_CLASS} WHERE role = 'declared'))"""
_FIELD = """(SELECT version_id, target AS module, 'c' || CAST(l_partkey % 50 AS VARCHAR) AS class_name,
    'f' || CAST(l_linenumber AS VARCHAR) AS field, 'm.k' || CAST(max(l_suppkey) AS VARCHAR) AS comodel,
    max(l_suppkey) AS line FROM x_ship WHERE l_linestatus = 'F' GROUP BY ALL)"""
KEYS = ("module", "class_name")


def _class_models(spark, sf):
    rows = frames.shipments(spark, sf).select(
        "version_id", F.col("target").alias("module"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string")).alias("class_name"),
        F.when(F.col("l_returnflag") == "R", "declared").otherwise("inherited").alias("role"),
        F.concat(F.lit("m.k"), (F.col("l_partkey") % 20).cast("string")).alias("model"),
    )
    return cut_lineage(rows.distinct())


def _own_fields(spark, sf):
    s = frames.shipments(spark, sf).where(F.col("l_linestatus") == "F")
    rows = s.groupBy(
        "version_id", F.col("target").alias("module"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string")).alias("class_name"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"),
    ).agg(F.concat(F.lit("m.k"), F.max("l_suppkey").cast("string")).alias("comodel"), F.max("l_suppkey").alias("line"))
    return cut_lineage(rows)


@query(
    "module_models",
    f"""SELECT DISTINCT version_id, module, role, model FROM {_CLASS} c WHERE role = 'inherited' OR NOT EXISTS
        (SELECT 1 FROM {_CLASS} i WHERE i.role = 'inherited' AND i.version_id = c.version_id AND i.module = c.module
         AND i.class_name = c.class_name AND i.model = c.model)""",
)
def _(spark, sf):
    return graph.module_models(_class_models(spark, sf), KEYS)


@query(
    "effective_fields",
    f"""SELECT version_id, module, class_name, field, coalesce(own, inherited) AS comodel FROM
        (SELECT version_id, module, class_name, field, comodel AS own FROM {_FIELD}) FULL JOIN
        (SELECT version_id, t.module, t.class_name, field, max_by(comodel, model) AS inherited FROM {_TARGET} t JOIN
         (SELECT version_id, model, field, list(comodel ORDER BY module, class_name, line)[-1] AS comodel
          FROM {_FIELD} JOIN {_TARGET} USING (version_id, module, class_name) GROUP BY ALL)
         USING (version_id, model) GROUP BY ALL)
        USING (version_id, module, class_name, field)""",
)
def _(spark, sf):
    return graph.effective_fields(_own_fields(spark, sf), _class_models(spark, sf), KEYS)


@query(
    "provider_index",
    f"""SELECT DISTINCT version_id, model, field AS member, module FROM {_FIELD} JOIN {_TARGET}
        USING (version_id, module, class_name)""",
)
def _(spark, sf):
    members = _own_fields(spark, sf).withColumnRenamed("field", "member")
    return graph.provider_index(members, _class_models(spark, sf), KEYS)


@query(
    "model_owners",
    f"""SELECT DISTINCT version_id, model, module FROM {_CLASS} c WHERE role = 'declared' AND NOT EXISTS
        (SELECT 1 FROM {_CLASS} i WHERE i.role = 'inherited' AND i.version_id = c.version_id AND i.module = c.module
         AND i.class_name = c.class_name AND i.model = c.model)""",
)
def _(spark, sf):
    return graph.model_owners(graph.module_models(_class_models(spark, sf), KEYS))


@query(
    "all_edge_facts",
    r"""SELECT kind, target, count(*) AS n FROM (SELECT 'xml_ref' AS kind, split_part(id, '.', 1) AS target FROM
       (SELECT unnest(regexp_extract_all(html, '([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)', 1)) AS id FROM pages)
       UNION ALL SELECT 'security_csv_ref', split_part(url, '/', 3) FROM pages
       UNION ALL SELECT 'manifest_depends', lang FROM documents) GROUP BY ALL""",
)
def _(spark, sf):
    pages, docs = frames.table(spark, sf, "pages"), frames.table(spark, sf, "documents")
    xml = pages.select(F.explode(external_ids("html")).alias("id")).select(
        F.lit("xml_ref").alias("kind"), id_module("id").alias("target")
    )
    csv = pages.select(F.lit("security_csv_ref").alias("kind"), F.split("url", "/")[2].alias("target"), "url")
    manifest = docs.select(F.lit("manifest_depends").alias("kind"), F.col("lang").alias("target"))
    return graph.all_edge_facts(csv, xml, manifest).groupBy("kind", "target").agg(F.count(F.lit(1)).alias("n"))


# --- filtered views -----------------------------------------------------------------------


@query(
    "visible_edges",
    """SELECT version_id, source, target, CAST(coalesce(model_reuse, 0) + coalesce(view_points, 0) AS BIGINT) AS visible_weight
       FROM x_edge WHERE coalesce(model_reuse, 0) + coalesce(view_points, 0) >= 2""",
)
def _(spark, sf):
    shown = traversal.visible_edges(frames.edges(spark, sf), ["model_reuse", "view"], minimum=2)
    return shown.select("version_id", "source", "target", F.col("visible_weight").cast("long").alias("visible_weight"))


_SALE = f"(SELECT DISTINCT {VERSION_SQL}, o_custkey, l_suppkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_FAR = f"""(SELECT DISTINCT version_id, 'C' || CAST(o_custkey AS VARCHAR) AS source, 'S' || CAST(l_suppkey AS VARCHAR) AS target FROM {_SALE}
    UNION SELECT version_id, 'S' || CAST(l_suppkey AS VARCHAR), 'P' || CAST(l_partkey AS VARCHAR) FROM {_SALE})"""
_SEEDS = f"(SELECT version_id, max(source) AS node FROM {_FAR} WHERE source LIKE 'C%' GROUP BY version_id)"


def _far_edges(spark, sf):
    """Customers to suppliers to parts: the deepest graph of the tables, stored once for all its readers."""
    orders = frames.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", *frames.version_columns())
    s = frames.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(orders, "l_orderkey")

    def node(letter, key):
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    sold = F.struct(node("C", "o_custkey").alias("source"), node("S", "l_suppkey").alias("target"))
    held = F.struct(node("S", "l_suppkey").alias("source"), node("P", "l_partkey").alias("target"))
    return stored(s.select("version_id", F.explode(F.array(sold, held)).alias("e")).select("version_id", "e.*").distinct(), "edges")


def _seeds(edges):
    return edges.where(F.col("source").startswith("C")).groupBy("version_id").agg(F.max("source").alias("node"))


def _walk_sql(depth: int, steps: str) -> str:
    ctes = [f"w0 AS (SELECT version_id, node, 0 AS hop FROM {_SEEDS})"]
    for i in range(1, depth + 1):
        ctes.append(
            f"w{i} AS (SELECT version_id, node, min(hop) AS hop FROM (SELECT * FROM w{i - 1} UNION ALL"
            f" SELECT version_id, nxt, {i} FROM w{i - 1} JOIN {steps} s USING (version_id, node) WHERE hop = {i - 1})"
            " GROUP BY ALL)"
        )
    return f"(WITH {', '.join(ctes)} SELECT * FROM w{depth})"


_OUT = f"(SELECT version_id, source AS node, target AS nxt FROM {_FAR})"
_BOTH = f"(SELECT version_id, source AS node, target AS nxt FROM {_FAR} UNION SELECT version_id, target, source FROM {_FAR})"


@query("neighborhood", f"SELECT version_id, node, CAST(hop AS INTEGER) AS hop FROM {_walk_sql(3, _OUT)}")
def _(spark, sf):
    edges = _far_edges(spark, sf)
    return traversal.neighborhood(edges, _seeds(edges), 3, "out", laid_out=True)


@query("neighborhood_both", f"SELECT version_id, node, CAST(hop AS INTEGER) AS hop FROM {_walk_sql(2, _BOTH)}")
def _(spark, sf):
    edges = _far_edges(spark, sf)
    return traversal.neighborhood(edges, _seeds(edges), 2, "both", laid_out=True)


@query(
    "graph_stats",
    f"""SELECT version_id, total_nodes, coalesce(total_edges, 0) AS total_edges, coalesce(visible_nodes, 0) AS visible_nodes,
        coalesce(visible_edges, 0) AS visible_edges, total_nodes - coalesce(visible_nodes, 0) AS hidden_nodes,
        coalesce(total_edges, 0) - coalesce(visible_edges, 0) AS hidden_edges
        FROM (SELECT version_id, count(*) AS total_nodes FROM (SELECT version_id, source FROM {_FAR} UNION SELECT version_id, target FROM {_FAR}) GROUP BY ALL)
        LEFT JOIN (SELECT version_id, count(*) AS total_edges FROM {_FAR} GROUP BY ALL) USING (version_id)
        LEFT JOIN (SELECT version_id, count(*) AS visible_nodes FROM {_walk_sql(2, _BOTH)} GROUP BY ALL) USING (version_id)
        LEFT JOIN (SELECT version_id, count(*) AS visible_edges FROM {_FAR} f
          JOIN {_walk_sql(2, _BOTH)} a USING (version_id) JOIN {_walk_sql(2, _BOTH)} b USING (version_id)
          WHERE a.node = source AND b.node = target GROUP BY ALL) USING (version_id)""",
)
def _(spark, sf):
    edges = _far_edges(spark, sf)
    near = traversal.neighborhood(edges, _seeds(edges), 2, "both", laid_out=True)
    nodes = edges.select("version_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    return traversal.graph_stats(nodes, edges, near, traversal.induced_edges(edges, near))

