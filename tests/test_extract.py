import ast

import pytest
from pyspark.sql import functions as F

from histmetrics.demo import frames
from histmetrics.extract import classes, complexity, contents, references
from histmetrics.plans.analysis import analyze_files, select_files

FILES = "version_id string, module string, relative_path string, content string"


def files(spark, *rows):
    return spark.createDataFrame([("v", *r) for r in rows], FILES)


def only(source):
    return next(complexity.functions_in(ast.parse(source).body))


@pytest.mark.parametrize(
    "body, cyclomatic, cognitive",
    [
        ("pass", 1, 0),
        ("if a: pass\n elif b: pass\n else: pass", 3, 3),
        ("if a:\n  if b: pass", 3, 3),
        ("if a: pass\n else:\n  if b: pass", 3, 4),
        ("for x in y:\n  while z: pass\n else: pass", 4, 4),
        ("try: pass\n except A: pass\n except B:\n  if a: pass\n else: pass", 5, 4),
        ("return a and b and c", 3, 1),
        ("return a and b or c", 3, 2),
        ("return [i for i in y if i]", 3, 0),
        ("return a if b else c", 2, 1),
        ("assert a", 2, 0),
        ("match a:\n  case 1: pass\n  case _: pass", 2, 1),
        ("with a: pass", 1, 0),
        ("def g():\n  if a: pass", 1, 2),
        ("return lambda: (a if b else c)", 2, 2),
    ],
)
def test_complexity_by_hand(body, cyclomatic, cognitive):
    function = only(f"def f():\n {body}\n")
    assert (complexity.cyclomatic(function), complexity.cognitive(function)) == (cyclomatic, cognitive)


def test_counted_functions():
    source = """
def a():
    def b(): pass
    class X:
        def not_counted(self): pass
class C:
    def d(self): pass
    class Inner:
        def not_counted(self): pass
if True:
    async def e(): pass
"""
    assert sorted(f.name for f in complexity.functions_in(ast.parse(source).body)) == ["a", "b", "d", "e"]


def test_nodes_per_line():
    assert dict(complexity.nodes_per_line(ast.parse("x = 1\n\ny = x + 1\n"))) == {1: 3, 3: 5}


def test_broken_files_fail_but_stay(spark, rows):
    given = files(
        spark, ("m", "a/ok.py", "def f():\n    return 1\n"), ("m", "a/bad.py", "def f(:\n"), ("n", "b/same.py", "def f(:\n"),
        ("m", "tests/bad.py", "def f(:\n"), ("m", "bytes.py", None), ("m", "empty.py", ""),
    )
    failed = rows(complexity.failures(given), "file_path", "error_text")
    assert failed == [
        ("m/a/bad.py", "invalid syntax (bad.py, line 1)"),
        ("m/bytes.py", "cannot decode file as UTF-8"),
        ("n/b/same.py", "invalid syntax (same.py, line 1)"),
    ]
    found = complexity.python_file_distributions(given)
    assert rows(found, "relative_path", "family", "count") == [
        ("a/ok.py", "cognitive", 1), ("a/ok.py", "cyclomatic", 1), ("a/ok.py", "jones", 2)
    ]


def test_copies_of_a_text_count_each_time(spark, rows):
    given = files(spark, ("m", "a.py", "x = 1\n"), ("m", "b.py", "x = 1\n"), ("m", "c.py", "y = 1 + 1\n"))
    out = complexity.python_module_distributions(given)
    assert rows(out, "family", "count", "mean") == [("jones", 3, pytest.approx((3 + 3 + 5) / 3))]


def test_error_policy(spark, rows):
    versions = spark.createDataFrame([("v0", 0), ("v1", 1)], "version_id string, version_order int")
    bad = spark.createDataFrame([("v1", "boom")], "version_id string, error_text string")
    assert rows(complexity.apply_error_policy(bad, versions), "version_id", "failed") == [("v0", False), ("v1", True)]
    assert complexity.apply_error_policy(bad.limit(0), versions, fail_fast=True).count() == 2
    with pytest.raises(Exception, match="boom"):
        complexity.apply_error_policy(bad, versions, fail_fast=True).collect()


XML = """<data xmlns="urn:x">
  <record id="a" model="ir.rule">
    <field name="model_id" ref="base.model_x"/>
    <field name="domain">[('a', '=', 1)]</field>
  </record>
  <record id="b" model="ir.ui.view">
    <field name="inherit_id" ref="base.view_y"/>
    <field name="inherit_id">plain</field>
    <a href="%(crm.act)d" ref="base.view_y"/>
  </record>
</data>
"""


def test_xml(spark, rows):
    given = files(spark, ("sale", "views/a.xml", XML), ("sale", "security/a.xml", '<a ref="base.b"/>'), ("sale", "x.xml", "<a>%(crm.q)d"))
    out = rows(references.xml_reference_facts(given), "file_path", "kind", "target", "line", "detail")
    assert out == [
        ("security/a.xml", "security_xml_ref", "base", 1, "ref -> base.b"),
        ("views/a.xml", "security_ir_rule_model_ref", "base", 3, "ir.rule model_id -> base.model_x"),
        ("views/a.xml", "security_ir_rule_ref", "base", 3, "ref -> base.model_x"),
        ("views/a.xml", "xml_inherit_id", "base", 7, "inherit_id -> base.view_y"),
        ("views/a.xml", "xml_percent_ref", "crm", 9, "%(crm.act)d"),
        ("views/a.xml", "xml_ref", "base", 7, "ref -> base.view_y"),
        ("views/a.xml", "xml_ref", "base", 9, "ref -> base.view_y"),
        ("x.xml", "xml_percent_ref", "crm", 1, "%(crm.q)d"),
    ]
    assert [r["file_path"] for r in references.xml_failures(given).collect()] == ["sale/x.xml"]


def test_csv(spark, rows):
    body = 'id,model\naccess_a,base.model_x\n\n"two\nlines","crm.a, crm.b"\nlast,none\n'
    given = files(spark, ("sale", "security/a.csv", body), ("sale", "data/a.csv", body), ("sale", "security/b.txt", body))
    assert rows(references.csv_reference_facts(given), "target", "line", "detail") == [
        ("base", 2, "security csv ref -> base.model_x"),
        ("crm", 3, "security csv ref -> crm.a"),
        ("crm", 3, "security csv ref -> crm.b"),
    ]
    broken = files(spark, ("sale", "security/a.csv", 'id\na.b\n"open\x00'), ("sale", "security/b.csv", None))
    told = {r["file_path"]: r["error_text"] for r in references.csv_failures(broken).collect()}
    assert told.get("sale/security/b.csv") == "cannot decode file as UTF-8"
    wide = "h\n" + "x" * 300_000 + " a.b\n"
    assert rows(references.csv_reference_facts(files(spark, ("s", "security/w.csv", wide))), "line") == [(2,)]


@pytest.mark.parametrize(
    "source, depends, reason",
    [
        ("{'depends': ['b', 'a', 'a', 'no-name', 3]}", ["a", "b"], None),
        ("'doc'\nmanifest = {'depends': ('a',)}", ["a"], None),
        ("x = {'depends': ['a']}\n__manifest__ = {}\n{'depends': ['b']}", [], None),
        ("manifest = call()\n{'depends': {'z'}}", ["z"], None),
        ("[1]", [], "no_manifest_assignment"),
        ("", [], "no_manifest_assignment"),
        ("{'a'", [], "literal_eval_failed"),
    ],
)
def test_manifest(source, depends, reason):
    assert references.read_manifest(source) == (depends, reason)


def source_of(body, models="_name = 'sale.order'"):
    return f"class A:\n    {models}\n    def f(self, env2):\n" + "".join(f"        {line}\n" for line in body.split("\n"))


def test_model_expressions(spark):
    go = ("call", "sale.order", "", "go")
    cases = [  # body, what must be among its uses, whether that is all
        ("self.env['res.partner']", [("env", "res.partner", "", None)], True),
        ("e = self.env\ne['res.partner'].go()", [("call", "res.partner", "", "go"), ("env", "res.partner", "", None)], False),
        ("self.go()", [go], False),
        ("rec = self.sudo().search([])\nrec.go()", [go], False),
        ("for r in self:\n    p = r.partner_id\n    p.go()", [("call", "sale.order", "partner_id", "go")], False),
        ("return self.partner_id.name", [("access", "sale.order", "partner_id", "name")], False),
        ("super().write({})", [("call", "sale.order", "", "write")], True),
        ("return self.id", [], True),
        ("return 42", [], True),
        ("with self.browse(1) as r:\n    r.x", [("access", "sale.order", "", "x")], False),
        ("if (r := self.exists()):\n    r.x", [("access", "sale.order", "", "x")], False),
        ("a, *b = self\nb.go()", [go], False),
        ("x = self\nx = 42\nx.go()", [go], False),
        ("x = self.env['a.b']\nx = self\nx.go()", [go], False),
        ("y.go()\ny = self", [], True),
        ("self.partner_id.env['a.b'].go()", [("access", "sale.order", "", "partner_id")], True),
    ]
    texts = [source_of(body) for body, _, _ in cases] + [source_of("self.go()", "_name = ['a', 'b']"), "def ("]
    given = files(spark, *[("m", f"f{i:02d}.py", text) for i, text in enumerate(texts)])
    found = {}
    for r in classes.python_class_facts(given).where("fact IN ('env', 'call', 'access')").collect():
        found.setdefault(r["file_path"], []).append((r["fact"], r["model"], r["chain"], r["member"]))
    for i, (body, want, whole) in enumerate(cases):
        got = found.get(f"f{i:02d}.py", [])
        assert set(want) <= set(got) and (not whole or len(got) == len(want)), (body, got)
    assert f"f{len(cases):02d}.py" not in found
    assert [r["file_path"] for r in classes.class_failures(given).collect()] == [f"f{len(cases) + 1:02d}.py"]


BASE = """
class Partner(models.Model):
    _name = 'res.partner'
    parent_id = fields.Many2one('res.partner')
    country_id = fields.Many2one(comodel_name='res.country')
    def greet(self): pass
    def _quiet(self): pass
class Country(models.Model):
    _name = 'res.country'
"""
SALE = """
class Order(models.Model):
    _name = 'sale.order'
    partner_id = fields.Many2one('res.partner')
    code = fields.Char(related='partner_id.country_id')
    @api.depends('partner_id.name', 'other')
    def total(self):
        self.partner_id.greet()
        self.partner_id.parent_id._quiet()
        return self.partner_id.country_id
class Extend(models.Model):
    _inherit = 'res.partner'
    @api.onchange('country_id')
    def changed(self): pass
"""


def test_python_links(spark, rows):
    given = files(spark, ("base", "models/p.py", BASE), ("sale", "models/s.py", SALE), ("sale", "models/bad.py", "def ("))
    known = given.select("version_id", "module").distinct()
    counted = rows(classes.python_links(given, known), "source", "target", "kind", "n")
    assert counted == [
        ("sale", "base", "python__inherit", 1),
        ("sale", "base", "python_api_depends", 1),
        ("sale", "base", "python_api_onchange", 1),
        ("sale", "base", "python_field_property_access", 2),
        ("sale", "base", "python_many2one", 1),
        ("sale", "base", "python_method_call", 1),
        ("sale", "base", "python_private_method_call", 1),
        ("sale", "base", "python_related", 1),
    ]
    told = classes.python_links(given, known, evidence=True)
    assert told.count() == sum(n for *_, n in counted)
    details = {r["detail"] for r in told.select("detail").collect()}
    assert "related=partner_id.country_id (code)" in details and "res.partner._quiet()" in details
    assert "@api.onchange('country_id') in changed" in details and "_inherit -> res.partner" in details


def test_copied_class_files_count_each_time(spark, rows):
    given = files(spark, ("base", "models/p.py", BASE), ("sale", "models/s.py", SALE), ("sale", "models/t.py", SALE))
    known = given.select("version_id", "module").distinct()
    counts = classes.python_links(given, known).groupBy("kind").agg(F.sum("n").alias("n"))
    told = classes.python_links(given, known, evidence=True).groupBy("kind").agg(F.count("*").alias("n"))
    assert rows(counts, "kind", "n") == rows(told, "kind", "n")


def test_two_modules_from_files_to_tables(spark, rows):
    manifest = "{'name': 'x', 'depends': ['base', 'gone']}"
    given = files(
        spark, ("base", "__manifest__.py", "{'depends': []}"), ("base", "models/p.py", BASE),
        ("sale", "__manifest__.py", manifest), ("sale", "models/s.py", SALE), ("sale", "security/r.xml", XML), ("sale", "models/bad.py", "def ("),
    )
    tables, failed = analyze_files(given)
    assert rows(tables["module_aggregate"], "module", "manifest_depends") == [("base", []), ("sale", ["base"])]
    edge = tables["coupling_edge"].collect()
    assert [(e["source"], e["target"]) for e in edge] == [("sale", "base")]
    assert set(edge[0]["kinds"]) == {
        "manifest_depends", "security_ir_rule_model_ref", "security_ir_rule_ref", "security_xml_ref", "xml_inherit_id"
    }
    assert rows(failed, "file_path") == [("sale/models/bad.py",)]
    assert tables["file_metric"].where("relative_path = 'models/p.py'").first()["line_counts"]["lines"] == BASE.count("\n")
    more, _ = analyze_files(given, python_links=True)
    assert "python__inherit" in more["coupling_edge"].first()["kinds"]


def test_texts_are_read_where_they_lie(spark):
    given = files(spark, *[("sale", f"views/{k}.xml", XML) for k in range(4)], ("sale", "x.xml", "<a>"), ("sale", "a.py", SALE), ("sale", "security/a.csv", "h\na.b"))
    for found in (references.xml_found(given), references.csv_found(given), complexity.content_values(given)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert moved and all("BroadcastExchange" in line and "content#" not in line for line in moved), plan
    assert references.xml_reference_facts(given).count() == 4 * 6


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 40 attributes over models in a ring, one that leaves it, and attributes that lead nowhere."""
    ring = [("v", f"m{k}", "next", f"m{(k + 1) % 9}") for k in range(9)] + [("v", "m3", "out", "other"), ("w", "m0", "next", "else")]
    fields = spark.createDataFrame(ring, "version_id string, model string, field string, comodel string")
    chains = [".".join(["next"] * n) for n in (1, 2, 3, 5, 8, 40)] + ["next.next.next.out.name.next", "nothing", "name.next", "next.name.next"]
    uses = spark.createDataFrame(
        [(v, "m0", c, "x", k) for k, c in enumerate([*chains, ""]) for v in ("v", "w")] + [("v", "unknown", "next.next", "x", 99)],
        "version_id string, model string, chain string, member string, line int",
    )
    rounds, cut = [], classes.cut_lineage
    monkeypatch.setattr(classes, "cut_lineage", lambda df: (rounds.append(1), cut(df))[1])
    got = {(r["version_id"], r["line"]): r["model"] for r in classes.resolve_chains(uses, fields).collect()}
    step = {(v, m, f): c for v, m, f, c in ring}
    for version in ("v", "w"):
        for k, chain in enumerate([*chains, ""]):
            here = "m0"
            for name in chain.split("."):
                here = step.get((version, here, name), here)
            assert got[version, k] == here, (version, chain)
    assert got["v", 99] == "unknown" and (len(rounds) - 2) // 2 <= 6


def test_scope_duplicates_and_stray_files(spark, rows):
    given = spark.createDataFrame(
        [
            ("v", "sale", "addons/sale", 0, "__manifest__.py", "{}"), ("v", "sale", "addons/sale", 0, "a.xml", "<a/>"),
            ("v", "sale", "vendor/sale", 1, "__manifest__.py", "{}"), ("v", "sale", "vendor/sale", 1, "b.xml", "<b/>"),
            ("v", "sale", "addons/sale", 0, "../crm/c.xml", "<c/>"), ("v", "sale", "addons/sale", 0, "x/../d.xml", "<d/>"),
            ("v", "sale_x", "vendor/sale_x", 2, "__manifest__.py", "{}"), ("v", "sale_docs", "addons/sale_docs", 3, "e.xml", "<e/>"),
            ("v", "crm", "addons/crm", 4, "__manifest__.py", "{}"),
        ],
        "version_id string, module string, path string, seq long, relative_path string, content string",
    )
    kept, skipped = select_files(given, prefixes=["sale"])
    assert rows(kept, "module", "relative_path") == [
        ("sale", "__manifest__.py"), ("sale", "a.xml"), ("sale", "x/../d.xml"), ("sale_x", "__manifest__.py")
    ]
    assert rows(skipped, "kept_path", "skipped_path") == [("addons/sale", "vendor/sale")]
    kept, _ = select_files(given, all_modules=True, policy="prefer_prefix", prefer="vendor")
    assert rows(kept, "module", "relative_path") == [
        ("crm", "__manifest__.py"), ("sale", "__manifest__.py"), ("sale", "b.xml"), ("sale_x", "__manifest__.py")
    ]


def test_files_are_not_shuffled_to_meet_few_facts(spark):
    """What was found in the texts is a small table: it goes to the files, and texts are hashed once."""
    given = files(spark, *[("sale", f"views/{k}.xml", XML) for k in range(4)], ("sale", "a.py", SALE), ("sale", "security/a.csv", "h\na.b"))
    found = {
        "xml": references.xml_reference_facts(given), "csv": references.csv_reference_facts(given),
        "values": complexity.function_complexity(given), "lines": complexity.line_density(given), "classes": classes.python_class_facts(given),
    }
    for name, df in found.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert all("BroadcastExchange" in line for line in moved) and "sha2(" not in plan, (name, plan)
    assert found["xml"].count() == 4 * 6 and found["classes"].count() > 0


def test_equal_names_with_other_texts_are_all_read(spark):
    """File keys ought to be unique; where they are not, each text still counts once."""
    given = files(spark, ("sale", "a.py", SALE), ("sale", "a.py", "x = 1\n"), ("base", "b.py", "x = 1\n"))
    keys = contents.hashed(given)
    assert contents.distinct_contents(given, keys=keys).count() == contents.distinct_contents(given).count() == 2


def test_files_are_gone_through_twice_and_not_shuffled_to_be_counted(spark):
    """Each text is asked for twice, whatever is made of the files: to say what it is, and to read one of each."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(name):
        made.add(1)
        return {"py": SALE, "xml": XML, "csv": "h\na.b"}.get(name.rsplit(".")[-1])

    names = [("sale", f"views/{k}.xml") for k in range(4)] + [("sale", "a.py"), ("sale", "security/a.csv"), ("base", "security/x.xml")]
    named = spark.createDataFrame([("v", *n) for n in names], "version_id string, module string, relative_path string")
    tables, failed = analyze_files(named.withColumn("content", text("relative_path")))
    plan = tables["file_metric"]._jdf.queryExecution().executedPlan().toString()
    assert all("BroadcastExchange" in line for line in plan.splitlines() if "Exchange" in line), plan
    for df in (*tables.values(), failed):
        df.collect()
    assert made.value <= 2 * len(names)


def test_counted_references_equal_single_ones(spark, rows):
    given = files(
        spark, *[("sale", f"views/{k}.xml", XML) for k in range(3)], ("sale", "security/r.xml", XML), ("crm", "x.xml", XML.replace("base", "sale")),
        ("crm", "y.xml", "<a>%(base.x)d"), ("sale", "security/a.csv", "h\nbase.a,base.b\nbase.a\n"), ("crm", "security/a.csv", "h\nbase.a,base.b\nbase.a\n"),
    )
    xml, csv = references.xml_found(given), references.csv_found(given)
    single = references.xml_reference_facts(given).unionByName(references.csv_reference_facts(given))
    for each in (True, False):
        counted = references.reference_counts(contents.with_sha(given), xml, csv, each).groupBy("source", "target", "kind").agg(F.sum("n").alias("n"))
        want = single.groupBy("source", "target", "kind").agg(F.count("*").alias("n"))
        columns = ("source", "target", "kind") + (("n",) if each else ())
        assert rows(counted, *columns) == rows(want, *columns) and want.count() > 5


def test_equal_texts_of_two_kinds_are_read_as_both(spark, rows):
    same = "class A:\n    def f(self):\n        return 1\n"
    given = files(spark, ("base", "a.py", same), ("base", "b.xml", same), ("base", "c.js", same), ("base", "tests/d.py", same), ("base", "security/e.csv", None))
    tables, failed = analyze_files(given)
    counts = {r["relative_path"]: (r["line_counts"]["function_count"], r["line_counts"]["lines"], len(r["metrics"])) for r in tables["file_metric"].collect()}
    assert counts == {"a.py": (1, 3, 12), "b.xml": (0, 3, 0), "c.js": (0, 3, 0), "tests/d.py": (0, 3, 0)} | ({"security/e.csv": (0, 0, 0)} if "security/e.csv" in counts else {})
    assert rows(failed, "file_path") == [("base/b.xml",), ("base/security/e.csv",)]


def test_files_of_stored_shipments_are_the_same(spark):
    sf = "/root/testdata/sf0.001"
    shipped = frames.stored_shipments(spark, sf)
    for make in (frames.xml_files, frames.csv_files, frames.class_files):
        once, joined = make(spark, sf, shipped), make(spark, sf)
        assert once.count() == joined.count() > 0 and once.exceptAll(joined).isEmpty()
