"""Facts to edges: linking, counting, scoring.

Facts are ``(version_id, source, target, kind[, file_path, line, detail])``.
Links through models, methods and fields are counted per source module before
they meet their owners, so one heavily used model does not multiply rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histmetrics.functions.catalog import KIND_GROUP
from histmetrics.functions.validate import MODULE
from histmetrics.session import stored

# Uses of one model or member that one task joins; more are split.
HEAVY = 100_000
EDGE = ("version_id", "source", "target")
FACT = ("version_id", "source", "target", "kind", "file_path", "line", "detail")


def group_of(kind: Column | str, kind_group: Mapping[str, str] = KIND_GROUP) -> Column:
    """Group of a kind; the table is a literal of some twenty entries."""
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in kind_group.items() for x in kv]), c)


def edge_included(score: Column | str = "score", include_zero: bool = False, minimum: int = 0) -> Column:
    """The one rule for which edges any read shows."""
    s = F.col(score) if isinstance(score, str) else score
    if include_zero:  # no filter at all, unless a minimum is asked for
        return s >= minimum if minimum > 0 else F.lit(True)
    return s >= max(minimum, 1)


def all_edge_facts(*streams: DataFrame) -> DataFrame:
    """All fact streams as one bag; columns a stream lacks become NULL."""
    first, *rest = streams
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def in_scope(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """Facts with a target other than the source that is an analysed module."""
    targets = modules.select("version_id", F.col("module").alias("target")).distinct()
    return facts.where(F.col("source") != F.col("target")).join(targets, ["version_id", "target"], "left_semi")


def kind_counts(facts: DataFrame, weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return facts.groupBy(*EDGE, "kind").agg(n.cast("long").alias("n"))


def presence_facts(
    facts: DataFrame, modules: DataFrame | None = None, kinds: Sequence[str] = tuple(KIND_GROUP)
) -> DataFrame:
    """One fact per pair and kind; bad names, unknown kinds and self pairs dropped."""
    clean = facts.where(
        F.col("source").rlike(MODULE)
        & F.col("target").rlike(MODULE)
        & F.col("kind").isin(*kinds)
        & (F.col("source") != F.col("target"))
    )
    once = clean.select(*EDGE, "kind").distinct()
    return in_scope(once, modules) if modules is not None else once


def edge_breakdown(counts: DataFrame, kind_group: Mapping[str, str] = KIND_GROUP) -> DataFrame:
    """Points per pair and group, long; kinds outside every group give no row."""
    return (
        counts.withColumn("group", group_of("kind", kind_group))
        .where(F.col("group").isNotNull())
        .groupBy(*EDGE, "group")
        .agg(F.sum("n").alias("points"))
    )


def edges_from_counts(counts: DataFrame, kind_group: Mapping[str, str] = KIND_GROUP) -> DataFrame:
    """Stored edge rows from kind counts.

    The map entries gathered per pair are at most one per kind.
    """
    groups = list(dict.fromkeys(kind_group.values()))
    sums = [F.sum(F.when(group_of("kind", kind_group) == g, F.col("n"))).alias(f"_{g}") for g in groups]
    packed = counts.groupBy(*EDGE).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("kind", F.col("n").cast("long").alias("n"))))
        ).alias("kinds"),
        F.sum("n").cast("long").alias("kind_occurrence_count"),
        *sums,
    )
    by_group = F.create_map(*[x for g in groups for x in (F.lit(g), F.col(f"_{g}").cast("long"))])
    total = sum((F.coalesce(F.col(f"_{g}"), F.lit(0)) for g in groups), F.lit(0))
    return packed.select(
        *EDGE,
        total.cast("long").alias("score"),
        "kinds",
        "kind_occurrence_count",
        F.map_filter(by_group, lambda _, v: v.isNotNull()).alias("breakdown"),
    )


def reduce_edge_facts(facts: DataFrame, kind_group: Mapping[str, str] = KIND_GROUP) -> DataFrame:
    """Edges with counted kinds; the order of the facts does not matter."""
    return edges_from_counts(kind_counts(facts), kind_group)


def build_coupling_edges(
    facts: DataFrame,
    modules: DataFrame,
    count_mode: str = "presence",
    kind_group: Mapping[str, str] = KIND_GROUP,
    kinds: Sequence[str] = tuple(KIND_GROUP),
    weight: str | None = None,
) -> DataFrame:
    """Edges among analysed modules.

    ``presence`` counts each kind once per pair; ``occurrence`` counts every fact.
    ``weight`` names a column that says how many facts a row stands for.
    """
    if count_mode == "presence":
        return reduce_edge_facts(presence_facts(facts, modules, kinds), kind_group)
    if count_mode != "occurrence":
        raise ValueError(f"count_mode must be presence or occurrence, got {count_mode!r}")
    clean = facts.where(
        F.col("source").rlike(MODULE) & F.col("target").rlike(MODULE) & F.col("kind").isin(*kinds)
    )
    counts = kind_counts(clean, weight)
    return edges_from_counts(in_scope(counts, modules), kind_group)


def edge_score(breakdown: Column | str) -> Column:
    """Sum of a breakdown map."""
    c = F.col(breakdown) if isinstance(breakdown, str) else breakdown
    return F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda acc, v: acc + v)


def module_scores(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming and outgoing score of every module; non-positive scores ignored."""
    ends = F.explode(
        F.array(
            F.struct(F.col("source").alias("module"), F.col("score").alias("out"), F.lit(0).alias("in")),
            F.struct(F.col("target").alias("module"), F.lit(0).alias("out"), F.col("score").alias("in")),
        )
    )
    sums = (
        edges.where(F.col("score") > 0)
        .select("version_id", ends.alias("e"))
        .groupBy("version_id", F.col("e.module").alias("module"))
        .agg(F.sum("e.out").alias("outgoing_score"), F.sum("e.in").alias("incoming_score"))
    )
    return modules.select("version_id", "module").join(sums, ["version_id", "module"], "left").select(
        "version_id",
        "module",
        F.coalesce("outgoing_score", F.lit(0)).cast("long").alias("outgoing_score"),
        F.coalesce("incoming_score", F.lit(0)).cast("long").alias("incoming_score"),
    )


# --- links --------------------------------------------------------------------


def deal_heavy(
    uses: DataFrame, owners: DataFrame, keys: Sequence[str], heavy: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a ``_salt``, so that no key brings more than about ``heavy`` uses to one task.

    Uses are counted per key; only keys above ``heavy`` (a table that holds a few rows per
    ``heavy`` uses at most) get several salts: their uses are split by a hash of the whole
    row, their owners are copied to each.
    """
    heavy = heavy or HEAVY
    counts = uses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy)
    salts = stored(counts.select(*keys, F.ceil(F.col("_n") / heavy).cast("int").alias("_salts")), "heavy")
    number = F.coalesce("_salts", F.lit(1))
    row = F.xxhash64(*[F.col(c) for c in uses.columns])
    split = uses.join(salts, list(keys), "left").withColumn("_salt", F.pmod(row, number).cast("int")).drop("_salts")
    copied = owners.join(salts, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), number - 1)))
    return split, copied.drop("_salts")


def _link(uses: DataFrame, owners: DataFrame, keys: list[str], modules: DataFrame, evidence: bool) -> DataFrame:
    """Uses ``(version_id, module, kind, …keys[, n])`` to facts against their owners.

    ``n`` says how many equal uses a row stands for.
    """
    where = ["version_id", *keys]
    provider = owners.select(*where, F.col("module").alias("target")).distinct()
    source = F.col("module").alias("source")
    if evidence:
        extra = [c for c in ("file_path", "line", "detail") if c in uses.columns]
        base = uses.select(*where, source, "kind", *extra)
        split, copied = deal_heavy(base, provider, where)
        return in_scope(split.join(copied, [*where, "_salt"]), modules).select(*EDGE, "kind", *extra)
    n = F.sum("n") if "n" in uses.columns else F.count(F.lit(1))
    base = uses.groupBy(*where, source, "kind").agg(n.alias("n"))
    linked = base.join(provider, where).groupBy(*EDGE, "kind").agg(F.sum("n").alias("n"))
    return in_scope(linked, modules).select(*EDGE, "kind", "n")


def link_models(uses: DataFrame, owners: DataFrame, modules: DataFrame, evidence: bool = False) -> DataFrame:
    """Uses of a model to every module that owns it, except the using one."""
    return _link(uses, owners, ["model"], modules, evidence)


def link_methods(calls: DataFrame, providers: DataFrame, modules: DataFrame, evidence: bool = False) -> DataFrame:
    """Method calls to providers of (model, member); a leading ``_`` marks private ones."""
    kind = F.when(F.col("member").startswith("_"), "python_private_method_call").otherwise("python_method_call")
    return _link(calls.withColumn("kind", kind), providers, ["model", "member"], modules, evidence)


def link_fields(accesses: DataFrame, providers: DataFrame, modules: DataFrame, evidence: bool = False) -> DataFrame:
    """Field accesses to providers of (model, member)."""
    uses = accesses.withColumn("kind", F.lit("python_field_property_access"))
    return _link(uses, providers, ["model", "member"], modules, evidence)


def resolve_paths(paths: DataFrame, fields: DataFrame, class_keys: Sequence[str]) -> DataFrame:
    """Dotted field paths to the co-model of their first field, as uses of that model.

    ``fields`` holds ``(version_id, …class_keys, field, comodel)``; paths whose
    first field is not relational are dropped.
    """
    keys = ["version_id", *class_keys, "field"]
    rooted = paths.withColumn("field", F.substring_index("path", ".", 1))
    known = fields.select(*keys, F.col("comodel").alias("model"))
    return rooted.join(known, keys).drop("field")


def link_manifests(manifests: DataFrame, modules: DataFrame, file_path: str | None = None) -> DataFrame:
    """Declared dependencies as facts: no self, analysed targets only."""
    target = F.explode(F.array_distinct("depends"))
    facts = manifests.select(
        "version_id",
        F.col("module").alias("source"),
        target.alias("target"),
        F.lit("manifest_depends").alias("kind"),
        (F.col(file_path) if file_path else F.lit(None).cast("string")).alias("file_path"),
        F.lit(0).alias("line"),
    ).withColumn("detail", F.concat(F.lit("depends -> "), F.col("target")))
    return in_scope(facts, modules).select(*FACT)


def in_scope_depends(manifests: DataFrame, modules: DataFrame) -> DataFrame:
    """Dependencies limited to analysed modules, sorted, one array per module.

    The arrays are no longer than the declared ones they came from.
    """
    known = modules.select("version_id", F.col("module").alias("depend")).distinct()
    kept = (
        manifests.select("version_id", "module", F.explode("depends").alias("depend"))
        .join(known, ["version_id", "depend"], "left_semi")
        .groupBy("version_id", "module")
        .agg(F.array_sort(F.collect_set("depend")).alias("manifest_depends"))
    )
    return manifests.select("version_id", "module").join(kept, ["version_id", "module"], "left").select(
        "version_id",
        "module",
        F.coalesce("manifest_depends", F.array().cast("array<string>")).alias("manifest_depends"),
    )


# --- classes, models, fields ----------------------------------------------------

CLASS = ("module", "file_path", "class_name")


def target_models(class_models: DataFrame, class_keys: Sequence[str] = CLASS) -> DataFrame:
    """Models a class stands for: those it declares, else those it inherits.

    ``class_models`` holds ``(version_id, …class_keys, role, model)`` with role
    ``declared`` or ``inherited``.
    """
    keys = ["version_id", *class_keys]
    declares = class_models.groupBy(*keys).agg(F.bool_or(F.col("role") == "declared").alias("_declares"))
    chosen = F.col("_declares") == (F.col("role") == "declared")
    return class_models.join(declares, keys).where(chosen).select(*keys, "model").distinct()


def model_fields(
    own_fields: DataFrame, class_models: DataFrame, class_keys: Sequence[str] = CLASS
) -> DataFrame:
    """Relational fields per model over the whole version; the last writer wins.

    Writers are ordered by their class keys, then by line.
    """
    keys = ["version_id", *class_keys]
    order = F.struct(*[F.col(k) for k in class_keys], F.col("line"))
    return (
        own_fields.join(target_models(class_models, class_keys), keys)
        .groupBy("version_id", "model", "field")
        .agg(F.max_by("comodel", order).alias("comodel"))
    )


def effective_fields(
    own_fields: DataFrame, class_models: DataFrame, class_keys: Sequence[str] = CLASS
) -> DataFrame:
    """Relational fields each class sees: those of its models, overridden by its own."""
    keys = ["version_id", *class_keys]
    inherited = (
        target_models(class_models, class_keys)
        .join(model_fields(own_fields, class_models, class_keys), ["version_id", "model"])
        .select(*keys, "field", "comodel", F.struct(F.lit(0).alias("own"), F.col("model").alias("by")).alias("rank"))
    )
    own = own_fields.select(
        *keys,
        "field",
        "comodel",
        F.struct(F.lit(1).alias("own"), F.lpad(F.col("line").cast("string"), 10, "0").alias("by")).alias("rank"),
    )
    return own.unionByName(inherited).groupBy(*keys, "field").agg(F.max_by("comodel", "rank").alias("comodel"))


def module_models(class_models: DataFrame, class_keys: Sequence[str] = CLASS) -> DataFrame:
    """Models per module and role: declared ones unless the same class inherits them."""
    keys = ["version_id", *class_keys, "model"]
    inherited = class_models.where(F.col("role") == "inherited")
    declared = class_models.where(F.col("role") == "declared").join(inherited.select(*keys), keys, "left_anti")
    return declared.unionByName(inherited).select("version_id", "module", "role", "model").distinct()


def model_owners(models: DataFrame) -> DataFrame:
    """Owners of a model: the modules that declare it (output of :func:`module_models`)."""
    return models.where(F.col("role") == "declared").select("version_id", "model", "module").distinct()


def provider_index(
    members: DataFrame, class_models: DataFrame, class_keys: Sequence[str] = CLASS
) -> DataFrame:
    """Modules that provide a (model, member), one row each.

    ``members`` holds ``(version_id, …class_keys, member)``: declared fields or methods.
    """
    keys = ["version_id", *class_keys]
    return (
        members.select(*keys, "member")
        .distinct()
        .join(target_models(class_models, class_keys), keys)
        .select("version_id", "model", "member", "module")
        .distinct()
    )
