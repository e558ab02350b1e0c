import pytest
from pyspark.sql import functions as F

from histmetrics.functions import text, validate, values
from histmetrics.operators import ordering
from histmetrics.plans import projections, reads


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "content, lines",
    [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\r\n", 2), ("a\rb", 2), ("\n\n", 2), ("a\n\nb\n", 3), ("\r\r\n", 2)],
)
def test_line_count(spark, content, lines):
    assert one(spark, content, text.line_count("x")) == lines


@pytest.mark.parametrize(
    "path, category",
    [
        ("models/order.py", "python_lines"),
        ("tests/order.py", "python_test_lines"),
        ("models/test_order.py", "python_test_lines"),
        ("models/Test_Order.PY", "python_test_lines"),
        ("a/order_test.py", "python_test_lines"),
        ("mytests/order.py", "python_lines"),
        ("static/x.test.js", "js_lines"),
        ("static/x.SCSS", "css_lines"),
        ("views/a.b.xml", "xml_lines"),
        ("page.html", "html_lines"),
        ("README", None),
        ("a.py/readme.md", None),
    ],
)
def test_line_category(spark, path, category):
    assert one(spark, path, text.line_category("x")) == category


def test_paths(spark):
    assert one(spark, "models.py", text.top_folder("x")) == "."
    assert one(spark, "models/partner.py", text.top_folder("x")) == "models"
    assert tuple(one(spark, "m/a/b.py", text.split_entity_path("x"))) == ("m", "a/b.py")
    for bad in ("m", "m/", "/a.py", ""):
        assert one(spark, bad, text.split_entity_path("x")) is None


def test_ids_and_lines(spark):
    assert one(spark, "base.view, x 1.2.3 %(sale.act)d", text.external_ids("x")) == ["base.view", "1.2", "sale.act"]
    assert one(spark, 'a="%(sale.act)d" %(x)d', text.percent_ids("x")) == ["sale.act"]
    assert one(spark, "a\nb\nc b", text.line_of("x", F.lit("b"))) == 2
    assert one(spark, "a\nb\nc b", text.line_of("x", F.lit("b"), 4)) == 3
    assert one(spark, "a", text.line_of("x", F.lit("z"))) == 0


def test_validators(spark):
    assert one(spark, "12aF", validate.valid_hash("x")) == "12aF"
    assert one(spark, "12g", validate.valid_hash("x")) is None
    assert one(spark, "9a", validate.valid_module("x")) is None
    assert one(spark, "res.partner", validate.valid_model("x")) == "res.partner"
    assert one(spark, "res..partner", validate.valid_model("x")) is None
    assert one(spark, "0012", validate.valid_epoch("x")) == 12
    assert one(spark, "-5", validate.valid_epoch("x")) is None
    assert one(spark, "a b@c", validate.valid_email("x")) is None
    assert one(spark, "abcdef12", validate.valid_run_id("x")) == "abcdef12"
    assert one(spark, "abcdef1", validate.valid_run_id("x")) is None


@pytest.mark.parametrize(
    "key, label",
    [
        ("cyclomatic_p95", "Cyclomatic complexity P95"),
        ("lines", "Total lines"),
        ("unknown_thing.x2y", "Unknown Thing X2Y"),
        ("other_mean", "Other Mean"),
        ("jones", "Jones complexity"),
    ],
)
def test_metric_label(spark, key, label):
    assert one(spark, key, values.metric_label("x")) == label


def test_labels_and_formats(spark):
    assert one(spark, "fooBAR_baz/q", values.fallback_label("x")) == "Foobar Baz Q"
    assert one(spark, " -- ", values.fallback_label("x")) == "—"
    assert one(spark, "xml_ref-kind", values.edge_label("x")) == "Xml ref kind"
    assert one(spark, 1234567, values.fmt_lines("x"), "long") == "1,234,567"
    assert [one(spark, v, values.fmt_compact("x"), "long") for v in (999, 1000, 1250, 2_000_000)] == ["999", "1k", "1.3k", "2M"]
    assert [one(spark, v, values.fmt_duration("x"), "long") for v in (59, 60, 192)] == ["59s", "1m0s", "3m12s"]
    assert one(spark, None, values.fmt_metric("x"), "double") == "0.00"


def test_metric_lookup(spark):
    df = spark.createDataFrame([({"cyclomatic_mean": 2.0, "files": 3.0}, {"lines": 9})], "m map<string,double>, c map<string,bigint>")
    got = df.select(
        values.metric_at("m", "cyclomatic_mean"), values.metric_at("m", "nothing"),
        values.metric_value("m", "c", "files", "mean"), values.metric_value("m", "c", "lines", "mean"),
    ).first()
    assert tuple(got) == (2.0, None, 3.0, 9.0)
    assert values.metric_key_of("a_mean", "mean") == "a_mean" and values.metric_key_of("a", "p95") == "a_p95"


def test_unreadable_json_is_kept(spark):
    df = values.parse_json_columns(spark.createDataFrame([('{"a": 1}', "oops")], "metrics string, kinds string"))
    row = df.first()
    assert row["metrics"] == {"a": 1.0} and row["metrics_raw"] is None
    assert row["kinds"] is None and row["kinds_raw"] == "oops"


def versions(spark):
    return spark.createDataFrame([("aa", 0), ("bb", 1), ("cc", 2)], "version_id string, version_order int")


def test_version_choice(spark):
    v = versions(spark)
    assert reads.resolve_version(v).first()[0] == "cc"
    assert reads.resolve_version(v, "aa").first()[0] == "aa"
    assert reads.resolve_version(v, 1).first()[0] == "bb"
    with pytest.raises(Exception, match="unknown version: zz"):
        reads.at_version(v, v, "zz").collect()


def test_scope(spark, rows):
    df = spark.createDataFrame([("sale",), ("sale_x",), ("crm",), ("hr",)], "module string")
    assert rows(reads.scope_modules(df, ["sale", "sale"], ["crm"])) == [("crm",), ("sale",), ("sale_x",)]
    assert reads.scope_modules(df).count() == 4
    assert reads.scope_modules(df, ["sale"], all_modules=True).count() == 4


def test_positions_and_neighbours(spark, rows):
    out = ordering.version_neighbors(versions(spark))
    assert rows(out) == [
        ("aa", 0, 0, None, "bb", False), ("bb", 1, 1, "aa", "cc", False), ("cc", 2, 2, "bb", None, True)
    ]


def candidates(spark):
    data = [("v", "m", "/a/1", 1), ("v", "m", "/a/2", 2), ("v", "m", "/b/3", 3), ("v", "m", "/b/4", 4), ("v", "n", "/a/5", 5)]
    return spark.createDataFrame(data, "version_id string, module string, path string, seq long")


def test_duplicates(spark, rows):
    kept, warned = ordering.resolve_duplicates(candidates(spark))
    assert rows(kept, "module", "path") == [("m", "/a/1"), ("n", "/a/5")]
    assert rows(warned, "kept_path", "skipped_path") == [("/a/1", "/a/2"), ("/a/1", "/b/3"), ("/a/1", "/b/4")]
    kept, warned = ordering.resolve_duplicates(candidates(spark), "prefer_prefix", "/b")
    assert rows(kept, "module", "path") == [("m", "/b/3"), ("n", "/a/5")]
    assert rows(warned, "kept_path", "skipped_path") == [("/a/1", "/a/2"), ("/b/3", "/a/1"), ("/b/3", "/b/4")]
    with pytest.raises(Exception, match="Duplicate module name m"):
        ordering.resolve_duplicates(candidates(spark), "fail")[0].collect()


def test_minmax(spark, rows):
    df = spark.createDataFrame([("v", 1.0), ("v", 3.0), ("v", 2.0), ("v", None), ("w", 5.0)], "version_id string, x double")
    assert rows(ordering.minmax_scale(df, "x"), "version_id", "scaled") == [("v", 0.0), ("v", 0.0), ("v", 0.5), ("v", 1.0), ("w", 0.5)]


def test_limit_with_flag(spark):
    df = spark.range(5)
    few = reads.limit_with_flag(df, 3, ["id"]).collect()
    assert [(r["id"], r["truncated"]) for r in few] == [(0, True), (1, True), (2, True)]
    assert not reads.limit_with_flag(df, 5, ["id"]).first()["truncated"]


def test_requests(spark, rows):
    asked = spark.createDataFrame(
        [("cyclomatic", "file", "p95"), ("nope", None, None), ("python_file_count", "file", None), ("function_count", "module", "max"), ("lines", None, "p50")],
        "metric string, level string, agg string",
    )
    assert rows(projections.validate_requests(asked), "metric", "agg", "reason") == [
        ("cyclomatic", "p95", None),
        ("function_count", "max", "file_scope_only"),
        ("lines", "p50", "unknown_aggregation"),
        ("nope", "mean", "unknown_metric"),
        ("python_file_count", "mean", "module_scope_only"),
    ]


def test_hotspots_read_each_aggregation(spark):
    modules = spark.createDataFrame(
        [("cc", "a", {"cyclomatic_mean": 2.0, "cyclomatic_p95": 9.0}), ("cc", "b", {"cyclomatic_mean": 4.0}), ("aa", "a", {"cyclomatic_mean": 99.0})],
        "version_id string, module string, metrics map<string,double>",
    )
    by_mean = reads.hotspots(modules, versions(spark)).collect()
    assert [(r["name"], r["current"], r["first"], r["growth"]) for r in by_mean] == [("b", 4.0, None, None), ("a", 2.0, None, None)]
    assert [r["name"] for r in reads.hotspots(modules, versions(spark), agg="p95").collect()] == ["a"]
    growth = reads.hotspots(modules, versions(spark), by="growth").collect()
    assert [(r["name"], r["growth"]) for r in growth] == [("b", 0.0), ("a", -97.0)]
