"""History-shaped frames over the driver's tables.

Versions are quarters of ``orders``, modules are part brands or nations, files
are part types and sizes, measured values are whole numbers. Source texts (XML,
CSV, Python, manifests) are written by Spark from table rows, one text per row,
so their right answers follow from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histmetrics import schemas
from histmetrics.functions.catalog import KIND_GROUP, STRICT_KIND_GROUP
from histmetrics.operators import graph, measures
from histmetrics.plans.reads import resolve_version
from histmetrics.session import scratch_path, stored
from histmetrics.sources.store import HistoryStore

FLAG_CATEGORY = {
    "AF": "python_lines",
    "AO": "js_lines",
    "NF": "python_test_lines",
    "NO": "xml_lines",
    "RF": "css_lines",
    "RO": "html_lines",
}
PRIORITY_KIND = {
    "1-URGENT": "python_many2one",
    "2-HIGH": "python__inherit",
    "3-MEDIUM": "xml_ref",
    "4-NOT SPECIFIED": "python_field_property_access",
    "5-LOW": "manifest_depends",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def version_columns(day: str = "o_orderdate") -> list[Column]:
    year, quarter = F.year(day), F.quarter(day)
    return [
        F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string")).alias("version_id"),
        (year * 4 + quarter).alias("version_order"),
    ]


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .select(*version_columns(), "o_orderdate")
        .groupBy("version_id", "version_order")
        .agg(
            F.min("o_orderdate").cast("timestamp").alias("authored_at"),
            F.max("o_orderdate").cast("timestamp").alias("committed_at"),
            F.concat(F.count(F.lit(1)).cast("string"), F.lit(" orders")).alias("summary"),
        )
        .withColumn("author_name", F.lit("author"))
        .withColumn("author_email", F.lit("author@example.org"))
        .select(*[f.name for f in schemas.VERSION.fields])
    )


def lines(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    """One row per line item, as a measured stretch of one file at one version.

    ``keep`` limits versions, modules or files before anything is measured.
    """
    # What crosses the network is a few small numbers; names are made after the joins.
    _, order = version_columns()
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), order)
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("module"),
        F.concat(F.lower("p_type"), F.lit("/size_"), F.col("p_size").cast("string")).alias("relative_path"),
    )
    items = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_quantity",
        F.concat("l_returnflag", "l_linestatus").alias("_flags"),
        F.round(F.col("l_extendedprice") * 100).alias("cognitive"),
        F.round(F.col("l_discount") * 100).alias("jones"),
    )
    before = F.col("version_order") - 1
    name = F.concat(F.floor(before / 4).cast("string"), F.lit("-Q"), (before % 4 + 1).cast("string"))
    found = items.join(orders, "l_orderkey").join(parts, "l_partkey").select(
        "l_partkey",
        "l_orderkey",
        F.col("l_quantity").cast("long").alias("lines"),
        _lookup(FLAG_CATEGORY, F.col("_flags")).alias("line_category_id"),
        F.col("l_quantity").alias("cyclomatic"),
        "cognitive",
        "jones",
        name.alias("version_id"),
        "version_order",
        "module",
        "relative_path",
    )
    return found if keep is None else found.where(keep)


def observed(stretches: DataFrame) -> DataFrame:
    """One row per stretch and metric family."""
    values = F.explode(
        F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("value")) for f in measures.FAMILIES])
    )
    return stretches.select("version_id", "module", "relative_path", values.alias("o")).select(
        "version_id", "module", "relative_path", "o.family", "o.value"
    )


def observations(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    return observed(lines(spark, sf, keep))


def module_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return measures.line_counts(lines(spark, sf))


def module_aggregate(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    # Read three times (once for counts, twice for ranks), joined once.
    kept = lines(spark, sf, keep).select(*measures.ENTITY_FILE, "line_category_id", "lines", *measures.FAMILIES)
    found = stored(kept, "lines")
    per_file = measures.line_counts(found, keys=measures.ENTITY_FILE)
    counts = measures.line_count_map(measures.roll_up_line_counts(per_file))
    dist = measures.module_distributions(observed(found))
    return measures.assemble_module_aggregates(counts, dist, "file_count")


def file_lines(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    return (
        lines(spark, sf, keep)
        .groupBy("version_id", "module", "relative_path")
        .agg(F.min("line_category_id").alias("line_category_id"), F.sum("lines").alias("lines"))
    )


def file_metric(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    return measures.measured_files(lines(spark, sf, keep))


_histories: dict[tuple[str, str], HistoryStore] = {}


def history(spark: SparkSession, sf: str) -> HistoryStore:
    """The whole stored history of the tables, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _histories:
        store = HistoryStore(spark, scratch_path(spark, "history"), versions_per_bucket=4)
        tables = {"module_aggregate": module_aggregate(spark, sf), "file_metric": file_metric(spark, sf), "coupling_edge": edges(spark, sf)}
        store.upsert_versions(versions(spark, sf), tables, spark.createDataFrame([], schemas.FAILURE))
        _histories[key] = store
    return _histories[key]


def is_version(versions: DataFrame, selector: str | None = None) -> Column:
    """Rows at one version, to be kept before they are measured."""
    return F.col("version_id") == resolve_version(versions, selector).scalar()


def modules(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("version_id", "module").distinct()


# --- graph ------------------------------------------------------------------------


def nations(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with version, buying nation and selling nation."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", *version_columns()
    )
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
        "l_linestatus",
    )
    return (
        items.join(orders, "l_orderkey")
        .join(customers, "o_custkey")
        .join(suppliers, "l_suppkey")
        .join(nations(spark, sf, "source", "c_nationkey"), "c_nationkey")
        .join(nations(spark, sf, "target", "s_nationkey"), "s_nationkey")
    )


def stored_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """What texts are made of, joined once for all who read it."""
    names = ["version_id", "source", "target", "c_nationkey", "s_nationkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    return stored(shipments(spark, sf).select(*names, _stem().alias("stem")), "shipments")


def edge_facts(spark: SparkSession, sf: str) -> DataFrame:
    return shipments(spark, sf).where(F.col("source") != F.col("target")).select(
        "version_id",
        "source",
        "target",
        _lookup(PRIORITY_KIND, F.col("o_orderpriority")).alias("kind"),
        F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("file_path"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("detail"),
    )


def edges(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    return graph.reduce_edge_facts(edge_facts(spark, sf), STRICT_KIND_GROUP if strict else KIND_GROUP)


def nation_modules(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that buy or sell at a version."""
    s = shipments(spark, sf)
    ends = F.explode(F.array("source", "target"))
    return s.select("version_id", ends.alias("module")).distinct()


def model_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that sell a part (flag R): owners of the model ``part.<key>``."""
    s = shipments(spark, sf).where(F.col("l_returnflag") == "R")
    return s.select("version_id", model_name().alias("model"), F.col("target").alias("module")).distinct()


def model_name() -> Column:
    return F.concat(F.lit("part.k"), F.col("l_partkey").cast("string"))


def model_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that buy a part (flag A), as uses of its model."""
    s = shipments(spark, sf).where(F.col("l_returnflag") == "A")
    return s.select(
        "version_id",
        F.col("source").alias("module"),
        model_name().alias("model"),
        F.when(F.col("l_linestatus") == "F", "_ship").otherwise("ship").alias("member"),
        F.lit("python_env_model").alias("kind"),
    )


# --- texts ------------------------------------------------------------------------

EXTENSIONS = ("py", "js", "xml", "html", "css", "scss", "txt", "test.js")


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    key = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (key % len(EXTENSIONS) + 1).cast("int"))
    folder = F.when(key % 5 == 0, F.lit("tests/")).when(key % 7 == 0, F.lit("")).otherwise(F.concat("lang", F.lit("/")))
    stem = F.concat(F.when(key % 11 == 0, F.lit("test_")).otherwise(F.lit("")), key.cast("string"))
    return docs.select(
        "doc_id",
        F.concat(F.lit("v"), (key % 3).cast("string")).alias("version_id"),
        F.col("source").alias("module"),
        F.concat(folder, stem, F.lit("."), ext).alias("relative_path"),
        F.col("text").alias("content"),
    )


def _stem() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    keys = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    parts = [k.cast("long").cast("string") for k in (*keys, cents)]
    return F.concat(F.lit("line_"), F.concat_ws("_", *parts))


def _file_of(folder: Column, extension: str, stem: Column | None = None) -> Column:
    return F.concat(folder, _stem() if stem is None else stem, F.lit(extension))


def _shipped(spark: SparkSession, sf: str, given: DataFrame | None) -> tuple[DataFrame, Column | None]:
    """Shipments, and where their files' names lie if they are made already."""
    return (shipments(spark, sf), None) if given is None else (given, F.col("stem"))


def xml_files(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """One XML text per shipment (or one of :func:`stored_shipments`); those with flag R lack their last tag."""
    folder = F.when(F.col("l_linestatus") == "F", F.lit("security/")).otherwise(F.lit("views/"))
    number = (F.col("l_partkey") % 200).cast("string")
    text = F.concat(
        F.lit('<data>\n  <record id="r" model="ir.rule">\n    <field name="model_id" ref="'),
        F.col("target"), F.lit(".model_"), number,
        F.lit('"/>\n    <field name="groups" ref="'),
        F.col("target"), F.lit(".group_"), number,
        F.lit('"/>\n  </record>\n  <record id="v" model="ir.ui.view">\n    <field name="inherit_id">'),
        F.col("target"), F.lit(".view_"), number,
        F.lit('</field>\n    <button name="%('),
        F.col("target"), F.lit(".action_"), number,
        F.lit(')d"/>\n    <menuitem ref="'),
        F.col("target"), F.lit(".menu_"), number,
        F.lit('"/>\n  </record>\n'),
        F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.lit("</data>\n")),
    )
    shipped, stem = _shipped(spark, sf, given)
    return shipped.select(
        "version_id", F.col("source").alias("module"), _file_of(folder, ".xml", stem).alias("relative_path"),
        text.alias("content"),
    )


def csv_files(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """One access list per shipment: a header, then one record per line number."""
    number = (F.col("l_partkey") % 200).cast("string")
    record = F.concat(
        F.lit('\naccess,"'), F.col("target"), F.lit(".model_"), number, F.lit('","see '),
        F.col("target"), F.lit(".group_"), number, F.lit(", all"), F.lit('",1')
    )
    text = F.concat(F.lit("id,model_id:id,group_id:id,perm_read"), F.array_join(F.array_repeat(record, F.col("l_linenumber")), ""), F.lit("\n"))
    shipped, stem = _shipped(spark, sf, given)
    return shipped.select(
        "version_id",
        F.col("source").alias("module"),
        _file_of(F.lit("security/"), ".csv", stem).alias("relative_path"),
        text.alias("content"),
    )


LOOPED = """
    def looped(self, items):
        for item in items:
            if item and self:
                pass
        return items


def outer():
    def inner(x):
        return x if x else 0
    return inner
"""


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    """One Python text per line item: as many branches as its quantity.

    Line number 7 gives test files; flag R with status O gives broken ones.
    """
    branches = F.repeat(F.lit("        if a:\n            a = 1\n"), F.col("l_quantity").cast("int"))
    good = F.concat(F.lit("class Line:\n    def plain(self, a):\n"), branches, F.lit("        return a\n"), F.lit(LOOPED))
    broken = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    text = F.when(broken, F.lit("def broken(:\n    pass\n")).otherwise(good)
    folder = F.when(F.col("l_linenumber") == 7, F.lit("tests/")).otherwise(F.lit("models/"))
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag",
        "l_linestatus",
    )
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), *version_columns())
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("module")
    )
    return items.join(orders, "l_orderkey").join(parts, "l_partkey").select(
        "version_id", "module", _file_of(folder, ".py").alias("relative_path"), text.alias("content"),
    )


def manifest_files(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest per customer, in four shapes: literal, assigned, no dict, broken."""
    key = F.col("c_custkey")
    listed = F.concat(
        F.lit("{'name': 'x', 'depends': ['"), F.lower("c_mktsegment"), F.lit("', 'nation_"),
        F.col("c_nationkey").cast("string"), F.lit("', 'not-a-name', 7]}\n"),
    )
    text = (
        F.when(key % 4 == 0, listed)
        .when(key % 4 == 1, F.concat(F.lit('"""doc"""\nmanifest = '), listed))
        .when(key % 4 == 2, F.lit("depends = ['base']\n"))
        .otherwise(F.lit("{'name': \n"))
    )
    return table(spark, sf, "customer").select(
        F.lit("v0").alias("version_id"),
        F.concat(F.lit("cust_"), key.cast("string")).alias("module"),
        F.lit("__manifest__.py").alias("relative_path"),
        text.alias("content"),
    )


def class_files(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Model files: one per selling nation and version, and one per shipment that uses them."""
    s, stem = _shipped(spark, sf, given)
    after = ((F.col("s_nationkey") + 1) % 25).cast("string")
    seller = F.col("s_nationkey").cast("string")
    declared = F.concat(
        F.lit("from odm import fields, models\n\n\nclass Seller(models.Model):\n    _name = 'res.n"), seller,
        F.lit("'\n    next_id = fields.Many2one('res.n"), after,
        F.lit("')\n    code = fields.Char(related='next_id.code')\n\n    def ship(self):\n        return True\n"),
    )
    providers = s.select("version_id", "target", "s_nationkey").distinct().select(
        "version_id", F.col("target").alias("module"), F.lit("models/seller.py").alias("relative_path"),
        declared.alias("content"),
    )
    used = F.concat(
        F.lit("class Buyer(models.Model):\n    _inherit = 'res.n"), F.col("c_nationkey").cast("string"),
        F.lit("'\n\n    @api.depends('next_id.code')\n    def run(self):\n        self.env['res.n"), seller,
        F.lit("'].ship()\n        rec = self.env['res.n"), seller,
        F.lit("'].search([])\n        for one in rec:\n            one.next_id.ship()\n        return self.sudo()._hidden()\n"),
    )
    users = s.select(
        "version_id", F.col("source").alias("module"), _file_of(F.lit("models/"), ".py", stem).alias("relative_path"),
        used.alias("content"),
    )
    return providers.unionByName(users)


# --- logs and events -----------------------------------------------------------------


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Six-field log records over orders and customers, with every kind of damage."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    at = F.unix_timestamp("o_orderdate").cast("string")
    mail = F.concat("c_name", F.when(key % 19 == 0, F.lit(" @")).otherwise(F.lit("@")), F.lower("c_mktsegment"))
    record = F.concat_ws(
        "\x1f",
        F.when(key % 17 == 0, F.lit("xyz")).otherwise(F.lower(F.hex(key))),
        "c_name",
        mail,
        F.when(key % 13 == 0, F.concat(F.lit("-"), at)).otherwise(at),
        at,
        F.when(key % 23 != 0, F.col("o_orderpriority")),
    )
    return orders.join(customers, "o_custkey").select(
        key.alias("seq"), F.when(key % 29 == 0, F.lit("  ")).otherwise(record).alias("value")
    )


def progress_events(events: DataFrame) -> DataFrame:
    """Events of the driver's stream table as progress events; works on streams too."""
    tag = _lookup(
        {
            "signup": "run_started",
            "view": "commit_progress",
            "click": "commit_progress",
            "purchase": "run_completed",
            "error": "run_failed",
        },
        F.col("event_type"),
    )
    return events.select(
        tag.alias("type"),
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("arrived_at"),
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("commits_total"),
        F.when(tag == "commit_progress", F.floor("value").cast("int")).alias("processed"),
    )

