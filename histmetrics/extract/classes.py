"""Model classes in Python files: what they declare, inherit and use.

The reader states what a file says: declarations, and for each method which names
it binds and which expressions it uses, as a root name and steps. What a name stands
for is found by Spark, in a fold over the events of one method; where an
expression's model depends on relational fields declared elsewhere, joins follow
the chain of attributes.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmetrics.extract.contents import copies, distinct_contents, extract, hashed, on_files
from histmetrics.functions.text import file_name
from histmetrics.operators import graph
from histmetrics.session import cut_lineage, stored

# Names with a meaning in model classes.
RELATIONAL = {
    "Many2one": "python_many2one",
    "One2many": "python_one2many",
    "Many2many": "python_many2many",
}
DECORATORS = {
    "depends": "python_api_depends",
    "onchange": "python_api_onchange",
    "constrains": "python_api_constrains",
}
NO_FIELD = {"id", "ids", "display_name", "env", "_name", "_context", "_origin"}
SAME_MODEL_METHODS = {
    "sudo",
    "with_context",
    "with_company",
    "with_user",
    "with_env",
    "search",
    "browse",
    "filtered",
    "filtered_domain",
    "sorted",
    "exists",
    "mapped",
}

READ = (
    "class_name string, fact string, model string, member string, path string, line int, "
    "method int, position int, names array<string>, root string, steps string"
)
FACT = ("class_name", "fact", "model", "chain", "member", "path", "line")
USES = ("env", "call", "access")


def _strings(node: ast.AST | None) -> list[str]:
    """String constants of a literal, alone or in a list."""
    parts = getattr(node, "elts", None) or [node]
    return [p.value for p in parts if isinstance(p, ast.Constant) and isinstance(p.value, str)]


def _first_string(*nodes: ast.AST | None) -> str | None:
    return next((t for node in nodes for t in _strings(node) if not hasattr(node, "elts")), None)


def _bound_names(target: ast.AST | None) -> list[str]:
    """Names that a target binds; attributes and items bind none."""
    loads = (ast.Attribute, ast.Subscript)
    if target is None or isinstance(target, loads):
        return []
    if isinstance(target, ast.Name):
        return [target.id]
    return [name for part in ast.iter_child_nodes(target) for name in _bound_names(part)]


def _expression(node: ast.AST | None) -> tuple[str, str] | None:
    """Root name and the steps from it (``.attribute`` or ``[key]``); methods that stay on the model are no steps."""
    steps = ""
    while node is not None:
        match node:
            case ast.Name(id=name):
                return name, steps
            case ast.Call(func=ast.Name(id="super")):
                return "super()", steps
            case ast.Call(func=ast.Attribute(attr=attr, value=value)) if attr in SAME_MODEL_METHODS:
                node = value
            case ast.Attribute(attr=attr, value=value):
                node, steps = value, f".{attr}{steps}"
            case ast.Subscript(value=value, slice=ast.Constant(value=str(key))) if key:
                node, steps = value, f"[{key}]{steps}"
            case _:
                return None
    return None


# Where Python binds names: node kind, its parts that hold targets and value.
_BINDS = {
    ast.Assign: lambda n: [(t, n.value) for t in n.targets],
    ast.AnnAssign: lambda n: [(n.target, n.value)],
    ast.NamedExpr: lambda n: [(n.target, n.value)],
    ast.For: lambda n: [(n.target, n.iter)],
    ast.AsyncFor: lambda n: [(n.target, n.iter)],
    ast.With: lambda n: [(i.optional_vars, i.context_expr) for i in n.items],
    ast.AsyncWith: lambda n: [(i.optional_vars, i.context_expr) for i in n.items],
}


def _events(method: ast.AST) -> Iterator[tuple]:
    """What a method binds and uses, as written and in order: (fact, names, member, root, steps, line)."""
    waiting = [(method, False)]
    while waiting:
        node, called = waiting.pop()
        for target, value in _BINDS.get(type(node), lambda _: [])(node):
            names, found = _bound_names(target), _expression(value)
            if names and found:
                yield "bind", names, None, *found, node_line(node)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            found = _expression(node.func.value)
            if found:
                yield "call", None, node.func.attr, *found, node.lineno
        elif isinstance(node, ast.Subscript):
            found = _expression(node)
            if found:
                yield "env", None, None, *found, node.lineno
        elif isinstance(node, ast.Attribute) and not called and node.attr not in NO_FIELD and not node.attr.startswith("__"):
            found = _expression(node.value)
            if found:
                yield "access", None, node.attr, *found, node.lineno
        parts = list(ast.iter_child_nodes(node))
        waiting += [(p, isinstance(node, ast.Call) and p is node.func) for p in reversed(parts)]


def node_line(node: ast.AST) -> int:
    return getattr(node, "lineno", 0)


def _declarations(node: ast.ClassDef) -> Iterator[tuple]:
    """Names, parents and fields that a class body states: (fact, model, member, path, line)."""
    for statement in node.body:
        if not isinstance(statement, (ast.Assign, ast.AnnAssign)):
            continue
        targets = statement.targets if isinstance(statement, ast.Assign) else [statement.target]
        names = [t.id for t in targets if isinstance(t, ast.Name)]
        for name, fact in (("_name", "declared"), ("_inherit", "inherited")):
            if name in names:
                models = _strings(statement.value)
                for model in dict.fromkeys(models) if fact == "declared" else models:
                    yield fact, model, None, None, statement.lineno
        match statement.value:
            case ast.Call(func=ast.Attribute(attr=kind, value=ast.Name(id="fields"))) as made if names:
                options = {k.arg: k.value for k in made.keywords}
                comodel = _first_string(*made.args[:1], options.get("comodel_name"))
                if kind in RELATIONAL and comodel:
                    yield RELATIONAL[kind], comodel, names[0], None, statement.lineno
                related = _first_string(options.get("related"))
                if related:
                    yield "python_related", None, names[0], related, statement.lineno


def _decorations(method: ast.AST) -> Iterator[tuple]:
    for decorator in method.decorator_list:
        match decorator:
            case ast.Call(func=ast.Attribute(attr=attr, value=ast.Name(id="api"))) if attr in DECORATORS:
                for path in (p for argument in decorator.args for p in _strings(argument)):
                    yield DECORATORS[attr], None, method.name, path, decorator.lineno


def read_classes(source: str | None) -> list[tuple]:
    """What the top-level classes of one file say, without knowing what names stand for; see ``READ``.

    A file that cannot be parsed has one row, ``unreadable``.
    """
    nothing = (None,) * 5
    try:
        body = ast.parse(source or "").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [("", "unreadable", None, None, f"{type(error).__name__}: {error}", None, *nothing)]
    out, times = [], Counter()
    for node in body:
        if not isinstance(node, ast.ClassDef):
            continue
        times[node.name] += 1
        name = node.name if times[node.name] == 1 else f"{node.name}#{times[node.name]}"
        out += [(name, *fact, *nothing) for fact in _declarations(node)]
        methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        for number, method in enumerate(methods):
            out.append((name, "method", None, method.name, None, method.lineno, *nothing))
            out += [(name, *fact, *nothing) for fact in _decorations(method)]
            for at, (fact, names, member, root, steps, line) in enumerate(_events(method)):
                out.append((name, fact, None, member, None, line, number, at, names, root, steps))
    return out


def _is_python():
    return F.col("relative_path").endswith(".py") & (file_name("relative_path") != "__manifest__.py")


def bind_names(read: DataFrame) -> DataFrame:
    """Uses with the model they start from and the attributes that follow.

    The events of one method, which its text bounds, are folded in order: a
    binding whose expression leads to a model replaces what the name stood for.
    An expression leads to the class's own model (``self``, ``super()``; only if
    the class has one) or to the model that is asked of the environment.
    """
    by_class = ["content_sha", "class_name"]
    models = read.where(F.col("fact").isin("declared", "inherited")).groupBy(*by_class).agg(
        F.collect_set(F.when(F.col("fact") == "declared", F.col("model"))).alias("declared"),
        F.collect_set("model").alias("all"),
    )
    models = models.withColumn("own", F.when(F.size("declared") > 0, F.col("declared")).otherwise(F.col("all")))
    models = models.select(*by_class, F.when(F.size("own") == 1, F.col("own")[0]).alias("own"))
    event = F.struct("position", "fact", "names", "member", "root", "steps", "line")
    methods = read.where(F.col("fact").isin("bind", *USES)).groupBy(*by_class, "method").agg(F.sort_array(F.collect_list(event)).alias("events"))

    def whole(known, e):
        own = F.when(e["root"].isin("self", "super()"), F.lit("@"))
        start = F.when(e["root"] == "super()", own).otherwise(F.coalesce(F.try_element_at(known, e["root"]), own))
        full = F.concat(start, e["steps"])
        return F.when(full.rlike(LEADS), full)

    def step(state, e):
        full = whole(state["known"], e)
        fresh = F.map_from_arrays(F.coalesce(e["names"], F.array().cast("array<string>")), F.transform(F.coalesce(e["names"], F.array().cast("array<string>")), lambda _: full))
        binds = (e["fact"] == "bind") & full.isNotNull()
        kept = F.map_filter(state["known"], lambda k, _: ~F.array_contains(F.coalesce(e["names"], F.array().cast("array<string>")), k))
        known = F.when(binds, F.map_concat(kept, fresh)).otherwise(state["known"])
        used = F.struct(e["fact"].alias("fact"), e["member"].alias("member"), e["line"].alias("line"), full.alias("full"))
        uses = F.when((e["fact"] != "bind") & full.isNotNull(), F.concat(state["uses"], F.array(used))).otherwise(state["uses"])
        return F.struct(known.alias("known"), uses.alias("uses"))

    none = F.struct(
        F.create_map().cast("map<string,string>").alias("known"),
        F.array().cast("array<struct<fact:string,member:string,line:int,full:string>>").alias("uses"),
    )
    # A name that is bound twice in one target is one name.
    events = F.transform("events", lambda e: e.withField("names", F.array_distinct(e["names"])))
    folded = methods.select(*by_class, F.explode(F.aggregate(events, none, step, lambda s: s["uses"])).alias("u"))
    asked = F.regexp_extract("u.full", r"^@[.]env\[([^\]]+)\]", 1)
    chain = F.regexp_replace(F.regexp_replace("u.full", r"^@([.]env\[[^\]]+\])?", ""), "^[.]", "")
    used = folded.join(models, by_class, "left").select(
        *by_class, F.col("u.fact").alias("fact"), F.when(asked != "", asked).otherwise(F.col("own")).alias("model"),
        chain.alias("chain"), F.col("u.member").alias("member"), F.lit(None).cast("string").alias("path"), F.col("u.line").alias("line"),
        (asked != "").alias("_asked"),
    )
    # A subscript is a use of the environment only where it asks for a model and nothing follows.
    plain = (F.col("fact") != "env") | (F.col("_asked") & (F.col("chain") == ""))
    return used.where(F.col("model").isNotNull() & plain).drop("_asked")


#: Expressions that lead to a model: own model and attributes, or a model asked of the environment and attributes.
LEADS = r"^@([.]env\[[^\]]+\])?([.]\w+)*$"


def read_facts(files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Class facts per distinct text, as a written table: a small one goes to the files."""
    read = stored(extract(distinct_contents(files, _is_python(), keys), read_classes, READ), "classes")
    stated = read.where(~F.col("fact").isin("bind", "unreadable", *USES)).withColumn("chain", F.lit(None).cast("string"))
    columns = ["content_sha", *FACT]
    return stored(stated.select(*columns).unionByName(bind_names(read).select(*columns)), "facts")


def class_failures(files: DataFrame) -> DataFrame:
    """Python files whose classes cannot be read: version_id, module, file_path, error_text."""
    read = extract(distinct_contents(files, _is_python()), read_classes, READ).where(F.col("fact") == "unreadable")
    found = on_files(read, files, _is_python())
    return found.select("version_id", "module", F.col("relative_path").alias("file_path"), F.col("path").alias("error_text"))


def python_class_facts(files: DataFrame) -> DataFrame:
    """Long class facts: ``(version_id, module, file_path, class_name, fact, model, chain, member, path, line)``."""
    keys = hashed(files, _is_python())
    found = on_files(read_facts(files, keys), keys, _is_python())
    return found.drop("content_sha").withColumnRenamed("relative_path", "file_path")


def module_class_facts(files: DataFrame) -> DataFrame:
    """The same facts once per module and text, with the number ``n`` of files they stand for."""
    keys = hashed(files, _is_python())
    found = copies(keys, _is_python()).join(read_facts(files, keys), "content_sha")
    return found.drop("content_sha").withColumnRenamed("relative_path", "file_path")


def class_models(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fact").isin("declared", "inherited")).select(
        "version_id", *graph.CLASS, F.col("fact").alias("role"), "model"
    )


def own_fields(facts: DataFrame) -> DataFrame:
    """Relational fields as declared; the last declaration in a class counts."""
    declared = facts.where(F.col("fact").isin(*RELATIONAL.values()))
    return declared.groupBy("version_id", *graph.CLASS, F.col("member").alias("field")).agg(
        F.max_by("model", "line").alias("comodel"), F.max("line").alias("line")
    )


def resolve_chains(uses: DataFrame, fields: DataFrame) -> DataFrame:
    """Follow attribute chains through relational fields; other attributes keep the model.

    A run of attributes is a map of models, given by the models that it changes. Neighbouring
    runs are put together two by two, so the number of rounds is the logarithm of the
    longest chain. Only distinct chains and runs are treated.
    """
    chains = uses.where(F.col("chain") != "").select("version_id", "chain").distinct()
    runs = cut_lineage(chains.withColumn("runs", F.split("chain", "[.]")))
    maps = fields.select("version_id", F.col("field").alias("run"), F.col("model").alias("here"), F.col("comodel").alias("there"))
    steps = runs.select("version_id", F.explode("runs").alias("run")).distinct()
    maps = cut_lineage(maps.join(steps, ["version_id", "run"], "left_semi"))
    longest = runs.agg(F.max(F.size("runs")).alias("n")).first()["n"] or 1
    while longest > 1:
        longest = -(-longest // 2)
        even = F.filter("runs", lambda _, i: i % 2 == 0)
        odd = F.filter("runs", lambda _, i: i % 2 == 1)
        pairs = runs.select("version_id", F.explode(F.arrays_zip(even.alias("left"), odd.alias("right"))).alias("p"))
        pairs = pairs.select("version_id", "p.left", "p.right").distinct()
        joined = F.concat_ws(".", "left", "right").alias("run")  # a last run without a partner stays as it is
        first = pairs.join(maps.withColumnRenamed("run", "left"), ["version_id", "left"])
        second = maps.select("version_id", F.col("run").alias("right"), F.col("here").alias("there"), F.col("there").alias("end"))
        through = first.join(second, ["version_id", "right", "there"], "left").select(
            "version_id", joined, "here", F.coalesce("end", "there").alias("there")
        )
        untouched = pairs.join(maps.withColumnRenamed("run", "right"), ["version_id", "right"]).join(
            first.select("version_id", "left", "right", "here"), ["version_id", "left", "right", "here"], "left_anti"
        )
        maps = cut_lineage(through.unionByName(untouched.select("version_id", joined, "here", "there")))
        ends = F.transform(F.arrays_zip(even.alias("left"), odd.alias("right")), lambda p: F.concat_ws(".", p["left"], p["right"]))
        runs = cut_lineage(runs.withColumn("runs", ends))
    # Few as they are, they go to the uses.
    ended = stored(maps, "chains").select("version_id", F.col("run").alias("chain"), F.col("here").alias("model"), F.col("there").alias("_end"))
    return (
        uses.join(ended, ["version_id", "chain", "model"], "left")
        .withColumn("model", F.coalesce("_end", "model"))
        .select(*[c for c in uses.columns if c != "chain"])
    )


def python_links(files: DataFrame, modules: DataFrame, evidence: bool = False) -> DataFrame:
    """Edge facts (or counts) from Python classes to the modules they rely on.

    The class facts feed every kind of link, so they are written out once.
    """
    facts = cut_lineage(python_class_facts(files) if evidence else module_class_facts(files))
    weight = [c for c in ("n",) if c in facts.columns]
    models, fields = class_models(facts), own_fields(facts)
    owners = graph.model_owners(graph.module_models(models))
    usable = graph.effective_fields(fields, models)

    direct = facts.where(F.col("fact").isin("inherited", *RELATIONAL.values())).select(
        "version_id",
        "module",
        "file_path",
        "model",
        F.when(F.col("fact") == "inherited", "python__inherit").otherwise(F.col("fact")).alias("kind"),
        "line",
        F.when(F.col("fact") == "inherited", F.concat(F.lit("_inherit -> "), F.col("model")))
        .otherwise(F.concat(F.col("member"), F.lit(" -> "), F.col("model"))).alias("detail"),
        *weight,
    )
    paths = facts.where(F.col("fact").isin("python_related", *DECORATORS.values())).select(
        "version_id", *graph.CLASS, "path", F.col("fact").alias("kind"), "line", "member", *weight
    )
    related = F.concat(F.lit("related="), F.col("path"), F.lit(" ("), F.col("member"), F.lit(")"))
    decorated = F.concat(
        F.lit("@api."), F.regexp_replace("kind", "^python_api_", ""), F.lit("('"), F.col("path"), F.lit("') in "),
        F.col("member"),
    )
    through = graph.resolve_paths(paths, usable, graph.CLASS).withColumn(
        "detail", F.when(F.col("kind") == "python_related", related).otherwise(decorated)
    ).select(*direct.columns)
    env = facts.where(F.col("fact") == "env").select(
        "version_id", "module", "file_path", "model", F.lit("python_env_model").alias("kind"), "line",
        F.concat(F.lit("self.env['"), F.col("model"), F.lit("'] access")).alias("detail"), *weight,
    )
    to_models = graph.link_models(
        direct.unionByName(through).unionByName(env), owners, modules, evidence
    )

    uses = resolve_chains(
        facts.where(F.col("fact").isin("call", "access")), graph.model_fields(fields, models)
    )
    calls = uses.where(F.col("fact") == "call").withColumn(
        "detail", F.concat("model", F.lit("."), "member", F.lit("()"))
    )
    accesses = uses.where(F.col("fact") == "access").withColumn(
        "detail", F.concat("model", F.lit("."), "member", F.lit(" access"))
    )
    methods = facts.where(F.col("fact") == "method")
    named = fields.withColumnRenamed("field", "member")
    to_methods = graph.link_methods(calls, graph.provider_index(methods, models), modules, evidence)
    to_fields = graph.link_fields(accesses, graph.provider_index(named, models), modules, evidence)
    return to_models.unionByName(to_methods).unionByName(to_fields)
