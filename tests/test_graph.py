import random

import pytest
from pyspark.sql import functions as F

from histmetrics.functions.catalog import STRICT_KIND_GROUP
from histmetrics.operators import graph, traversal
from histmetrics.plans import series
from histmetrics.session import folder_names, scratch_root

FACTS = [
    ("v", "sale", "base", "python_many2one"),
    ("v", "sale", "base", "python_many2one"),
    ("v", "sale", "base", "xml_ref"),
    ("v", "base", "sale", "python__inherit"),
]


def facts(spark, data=FACTS):
    return spark.createDataFrame(data, "version_id string, source string, target string, kind string")


def modules(spark, *names):
    return spark.createDataFrame([("v", n) for n in names], "version_id string, module string")


def test_reduce_counts_kinds(spark):
    got = {(r["source"], r["target"]): r for r in graph.reduce_edge_facts(facts(spark)).collect()}
    edge = got[("sale", "base")]
    assert edge["kinds"] == {"python_many2one": 2, "xml_ref": 1}
    assert (edge["score"], edge["kind_occurrence_count"]) == (3, 3)
    assert edge["breakdown"] == {"model_reuse": 2, "view": 1}
    assert got[("base", "sale")]["breakdown"] == {"extension_or_method": 1}


def test_kinds_are_stored_in_order(spark):
    ordered = graph.reduce_edge_facts(facts(spark)).where("source = 'sale'").select(F.map_keys("kinds")).first()[0]
    assert ordered == ["python_many2one", "xml_ref"]


def test_reduce_does_not_depend_on_order(spark, rows):
    def flat(df):
        return rows(df, "source", "target", "score", F.to_json("kinds").alias("k"), F.to_json("breakdown").alias("b"))

    assert flat(graph.reduce_edge_facts(facts(spark))) == flat(graph.reduce_edge_facts(facts(spark, FACTS[::-1])))


def test_breakdown(spark, rows):
    counts = spark.createDataFrame(
        [("v", "a", "b", k, n) for k, n in [("python_many2one", 2), ("xml_ref", 3), ("python_field_property_access", 1), ("python_method_call", 4)]],
        "version_id string, source string, target string, kind string, n long",
    )
    assert rows(graph.edge_breakdown(counts), "group", "points") == [
        ("extension_or_method", 4), ("field_property", 1), ("model_reuse", 2), ("view", 3)
    ]


def test_count_modes(spark):
    extra = [*FACTS, ("v", "sale", "gone", "xml_ref"), ("v", "sale", "base", "imports"), ("v", "sale", "sale", "xml_ref")]
    known = modules(spark, "sale", "base")
    once = graph.build_coupling_edges(facts(spark, extra), known, "presence").where("source = 'sale'").first()
    every = graph.build_coupling_edges(facts(spark, extra), known, "occurrence").where("source = 'sale'").first()
    assert (once["target"], once["score"]) == ("base", 2)
    assert (every["target"], every["score"]) == ("base", 3)
    with pytest.raises(ValueError):
        graph.build_coupling_edges(facts(spark), known, "other")


def test_zero_point_kinds_stay_visible(spark):
    only = facts(spark, [("v", "a", "b", "manifest_depends")])
    edge = graph.reduce_edge_facts(only, STRICT_KIND_GROUP).first()
    assert (edge["score"], edge["kinds"], edge["breakdown"]) == (0, {"manifest_depends": 1}, {})
    assert graph.reduce_edge_facts(only).first()["score"] == 1


def test_scores_sum_up(spark, rows):
    out = graph.module_scores(modules(spark, "sale", "base", "lone"), graph.reduce_edge_facts(facts(spark)))
    assert rows(out, "module", "outgoing_score", "incoming_score") == [("base", 1, 3), ("lone", 0, 0), ("sale", 3, 1)]


def test_links(spark, rows):
    owners = spark.createDataFrame([("v", "m.x", "base"), ("v", "m.x", "sale"), ("v", "m.x", "far")], "version_id string, model string, module string")
    uses = spark.createDataFrame(
        [("v", "sale", "m.x", "python_env_model", 3)] * 2, "version_id string, module string, model string, kind string, line int"
    )
    known = modules(spark, "sale", "base")
    assert rows(graph.link_models(uses, owners, known), "source", "target", "n") == [("sale", "base", 2)]
    assert rows(graph.link_models(uses, owners, known, evidence=True), "target", "line") == [("base", 3), ("base", 3)]


def test_effective_fields(spark, rows):
    schema = "version_id string, module string, file_path string, class_name string"
    models = spark.createDataFrame(
        [("v", "a", "f", "A", "declared", "x"), ("v", "b", "f", "B", "inherited", "x"), ("v", "c", "f", "C", "inherited", "x")],
        schema + ", role string, model string",
    )
    own = spark.createDataFrame(
        [("v", "a", "f", "A", "p", "old", 1), ("v", "b", "f", "B", "p", "new", 1), ("v", "c", "f", "C", "q", "mine", 1)],
        schema + ", field string, comodel string, line int",
    )
    assert rows(graph.effective_fields(own, models), "class_name", "field", "comodel") == [
        ("A", "p", "old"), ("A", "q", "mine"), ("B", "p", "new"), ("B", "q", "mine"), ("C", "p", "new"), ("C", "q", "mine")
    ]


def test_module_models(spark, rows):
    models = spark.createDataFrame(
        [("v", "a", "f", "A", "declared", "x"), ("v", "a", "f", "A", "inherited", "x"), ("v", "a", "f", "B", "declared", "y")],
        "version_id string, module string, file_path string, class_name string, role string, model string",
    )
    assert rows(graph.module_models(models), "role", "model") == [("declared", "y"), ("inherited", "x")]


def chain(spark):
    return spark.createDataFrame(
        [("v", "a", "b"), ("v", "b", "c"), ("v", "c", "a"), ("v", "c", "d"), ("v", "x", "a")],
        "version_id string, source string, target string",
    )


def test_neighbourhood(spark, rows):
    seed = spark.createDataFrame([("v", "a")], "version_id string, node string")
    walk = lambda *a: rows(traversal.neighborhood(chain(spark), seed, *a), "node", "hop")
    assert walk(2, "out") == [("a", 0), ("b", 1), ("c", 2)]
    assert walk(1, "in") == [("a", 0), ("c", 1), ("x", 1)]
    assert walk(2, "both") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("x", 1)]
    assert walk(5, "out") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert walk(60, "out") == walk(5, "out")
    with pytest.raises(ValueError):
        walk(0, "out")


def test_visible_edges_and_points(spark, rows):
    edges = graph.reduce_edge_facts(facts(spark))
    assert rows(traversal.visible_edges(edges, ["model_reuse"]), "source", "visible_weight") == [("sale", 2)]
    assert traversal.visible_edges(edges, [], include_zero=True).count() == 0
    versions = spark.createDataFrame([("v", 0)], "version_id string, version_order int")
    pairs = spark.createDataFrame([("sale", "base"), ("sale", "x")], "source string, target string")
    assert rows(series.edge_points(pairs, edges, versions), "target", "category", "points", "why_points", "missing") == [
        ("base", "model_reuse", 2, "python_many2one=2", False), ("base", "view", 1, "xml_ref=1", False), ("x", None, None, None, True)
    ]


def test_relations_diff(spark, rows):
    edges = spark.createDataFrame(
        [("p", "a", "b", 1), ("p", "a", "c", 2), ("q", "a", "c", 5), ("q", "d", "c", 3), ("q", "z", "c", 0)],
        "version_id string, source string, target string, score int",
    )
    versions = spark.createDataFrame([("p", 0), ("q", 1)], "version_id string, version_order int")
    assert rows(series.relations_diff(edges, versions, "p", "q")) == [("a", "b", "removed", 1, None), ("d", "c", "added", None, 3)]


def test_heavy_keys_are_joined_by_many_tasks(spark, rows):
    """One model with a third of all uses; no salt of it brings more than about ``heavy`` of them together."""
    uses = spark.range(900).select(
        F.lit("v").alias("version_id"), F.concat(F.lit("m"), F.col("id") % 7).alias("module"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("model"),
        F.lit("python_many2one").alias("kind"), F.concat(F.lit("f"), F.col("id")).alias("file_path"), F.col("id").cast("int").alias("line"),
    )
    owners = spark.createDataFrame([("v", "hot", "a"), ("v", "hot", "b"), ("v", "x1", "a")], "version_id string, model string, target string")
    split, copied = graph.deal_heavy(uses, owners, ["version_id", "model"], heavy=50)
    sizes = {(r["model"], r["_salt"]): r["count"] for r in split.groupBy("model", "_salt").count().collect()}
    assert len([k for k in sizes if k[0] == "hot"]) == 6 and max(sizes.values()) < 75
    joined = split.join(copied, ["version_id", "model", "_salt"]).select("file_path", "target")
    assert rows(joined) == rows(uses.join(owners, ["version_id", "model"]).select("file_path", "target"))
    modules = spark.createDataFrame([("v", "a"), ("v", "b")], "version_id string, module string")
    named = owners.withColumnRenamed("target", "module")
    found = graph.link_models(uses, named, modules, evidence=True)
    assert found.count() == 2 * 300 + 1


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_neighbourhoods_match_a_plain_walk(spark, direction):
    rng = random.Random(3)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)}
    edges = spark.createDataFrame([("v", str(a), str(b)) for a, b in pairs], "version_id string, source string, target string")
    seeds = spark.createDataFrame([("v", "1"), ("v", "2"), ("v", "2")], "version_id string, node string")
    near = {(a, b) for a, b in pairs if direction != "in"} | {(b, a) for a, b in pairs if direction != "out"}
    for depth in (1, 3, 9):
        want, frontier = {1: 0, 2: 0}, {1, 2}
        for hop in range(1, depth + 1):
            frontier = {b for a, b in near if a in frontier} - want.keys()
            want.update(dict.fromkeys(frontier, hop))
        got = {int(r["node"]): r["hop"] for r in traversal.neighborhood(edges, seeds, depth, direction).collect()}
        assert got == want


def test_stored_edges_are_walked_where_they_lie(spark, tmp_path):
    pairs = [("v", str(i), str(i + 1)) for i in range(30)] * 2
    spark.createDataFrame(pairs, "version_id string, source string, target string").write.parquet(str(tmp_path / "e"))
    edges = spark.read.parquet(str(tmp_path / "e"))
    seeds = spark.createDataFrame([("v", "10")], "version_id string, node string")
    before = set(folder_names(spark, f"{scratch_root(spark)}/histmetrics"))
    got = traversal.neighborhood(edges, seeds, 2, "both", laid_out=True)
    assert sorted((int(r["node"]), r["hop"]) for r in got.collect()) == [(8, 2), (9, 1), (10, 0), (11, 1), (12, 2)]
    made = set(folder_names(spark, f"{scratch_root(spark)}/histmetrics")) - before
    assert {name.split("-")[0] for name in made} == {"frontier"}
