"""Distributions and line counts.

Shape of the data: long observations ``(…keys, family, value)``. A third of all
rows may belong to one key, so no key gathers its rows: they are first counted by
place (value steps that are the same at every scale), then by value only at the few
places that hold a median or a p95, and places that still hold many values are
narrowed further. All counts are combined before their shuffle. Files bound their own
values: at that grain ranks are found in one shuffle. NaN counts as the highest value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histmetrics.functions.catalog import FAMILIES, LINE_CATEGORIES
from histmetrics.functions.text import file_name, is_test_path, line_category
from histmetrics.schemas import DISTRIBUTION
from histmetrics.session import cut_lineage, stored

STATS = ("count", "mean", "median", "p95", "max")
ENTITY_FILE = ("version_id", "module", "relative_path")
ENTITY_MODULE = ("version_id", "module")

# A place with more distinct values than PLACE_VALUES is cut into RANGES.
RANGES, PLACE_VALUES = 64, 65_536
P95 = 0.95


def value_histogram(
    df: DataFrame, keys: Sequence[str], value: str = "value", weight: str | None = None
) -> DataFrame:
    """``(…keys, value, n)``: how often each distinct value occurs per key."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    v = F.col(value).cast("double").alias("value")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, v).agg(n.cast("long").alias("n"))


def coarsen(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A histogram over fewer keys, from counts and not from the raw rows."""
    return histogram.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def _place(v: Column) -> Column:
    """A number that grows with the value: sixteen steps per power of two and sign, the same at every scale."""
    step = F.floor(F.log2(F.abs(v)) * 16) + 20_000  # positive down to the smallest double
    signed = F.when(v < 0, -step).otherwise(step)
    edge = F.when(F.isnan(v), 10**6).when(v == 0, 0).when(v == float("inf"), 10**5).when(v == float("-inf"), -(10**5))
    return edge.otherwise(signed).cast("int")


def _located(sums: DataFrame, targets: DataFrame | None, group: list[str], place: str) -> DataFrame:
    """Which ``place`` of its group holds each rank, and the rank's position ``_at`` inside it."""
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sums.withColumn("_upto", upto)
    if targets is not None:
        placed = placed.join(targets, group)
    before = F.col("_upto") - F.col("_n")
    held = (F.col("_at") > before) & (F.col("_at") <= F.col("_upto"))
    return placed.where(held).select(*group, place, "_rank", (F.col("_at") - before).alias("_at"))


def _narrowed(held: DataFrame, targets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Values and targets of places with at most ``PLACE_VALUES`` distinct values.

    As long as one holds more, its values are cut into ranges by a sketch of them, and
    only those that hold a rank are kept: the number of rounds follows the logarithm of
    what a place holds, and no window is larger than ``PLACE_VALUES`` rows.
    """
    group = [*keys, "_place"]
    while True:
        sizes = held.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))
        most = sizes.agg(F.max("_m").alias("m")).first()["m"]
        if most is None or most <= PLACE_VALUES:
            return held, targets
        cuts = F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 16 * RANGES)
        bounds = held.groupBy(*group).agg(cuts.alias("_cuts"))
        below = F.size(F.filter("_cuts", lambda c: c < F.col("value")))
        ranged = held.join(bounds, group).select(*group, below.alias("_range"), "value", "n")
        sums = ranged.groupBy(*group, "_range").agg(F.sum("n").alias("_n"))
        found = stored(_located(sums, targets, group, "_range"), "targets")
        path = F.concat_ws("/", F.col("_place").cast("string"), F.col("_range").cast("string"))
        kept = ranged.join(found.select(*group, "_range").distinct(), [*group, "_range"], "left_semi")
        held = cut_lineage(kept.select(*keys, path.alias("_place"), "value", "n"))
        targets = found.select(*keys, path.alias("_place"), "_rank", "_at")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The five numbers of each key's values ``(…keys, value, n)``, by narrowing down the places that hold the ranks."""
    sums = rows.groupBy(*keys, _place(F.col("value")).alias("_place")).agg(
        F.sum("n").alias("_n"), F.sum(F.col("value") * F.col("n")).alias("_sum"), F.max("value").alias("_max")
    )
    sums = cut_lineage(sums)
    n = F.col("count")
    ranks = {
        "low": F.floor((n + 1) / 2),
        "high": F.floor(n / 2) + 1,
        "p95": F.greatest(F.lit(1), F.ceil(F.lit(P95) * n)),
    }
    totals = sums.groupBy(*keys).agg(
        F.sum("_n").alias("count"), (F.sum("_sum") / F.sum("_n")).alias("mean"), F.max("_max").alias("max")
    )
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("_rank"), at.cast("long").alias("_at")) for r, at in ranks.items()]))
    asked = totals.select(*keys, each.alias("_t")).select(*keys, "_t.*")
    targets = stored(_located(sums, asked, keys, "_place"), "targets")
    # Second reading: only values at places that hold a rank are counted one by one.
    placed = rows.withColumn("_place", _place(F.col("value")))
    inside = placed.join(targets.select(*keys, "_place").distinct(), [*keys, "_place"], "left_semi")
    held = cut_lineage(inside.groupBy(*keys, "_place", "value").agg(F.sum("n").alias("n")))
    held, targets = _narrowed(held, targets, keys)
    values = _located(held.withColumnRenamed("n", "_n"), targets, [*keys, "_place"], "value")
    picked = values.groupBy(*keys).agg(*[F.max(F.when(F.col("_rank") == r, F.col("value"))).alias(f"_{r}") for r in ranks])
    return totals.join(picked, keys).select(
        *keys, "count", "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), F.col("_p95").alias("p95"), "max"
    )


def distribution_of(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`distribution` of values that are counted already ``(…keys, value, n)``."""
    keys = list(keys)
    for key in (*keys, "value"):
        histogram = histogram.where(F.col(key).isNotNull())
    return _ranked(cut_lineage(histogram.select(*keys, "value", "n")), keys)


def distribution(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """count, mean, median, nearest-rank p95 and max of each key's values.

    ``keys`` must not be NULL. Median is the mean of the two middle values; p95
    is the value at position ``ceil(0.95 n)`` of the sorted values. The rows are read
    twice, and combined before both shuffles.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    for name in (*keys, "value"):
        rows = rows.where(F.col(name).isNotNull())
    return _ranked(rows, keys)


def bounded_distributions(values: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """:func:`distribution` where each key bounds its own values: gathered once, sorted where they are."""
    value = F.col("value").cast("double")
    if weight is None:
        v = F.sort_array(F.collect_list(value))
    else:
        counted = F.sort_array(F.collect_list(F.struct(value.alias("value"), F.col(weight).cast("int").alias("n"))))
        v = F.flatten(F.transform(counted, lambda c: F.array_repeat(c["value"], c["n"])))
    gathered = values.where(F.col("value").isNotNull()).groupBy(*keys).agg(v.alias("v"))
    n = F.size("v")
    middle = F.get("v", F.floor((n + 1) / 2).cast("int") - 1) + F.get("v", F.floor(n / 2).cast("int"))
    return gathered.select(
        *keys,
        n.cast("long").alias("count"),
        (F.aggregate("v", F.lit(0.0), lambda total, x: total + x) / n).alias("mean"),
        (middle / 2).alias("median"),
        F.get("v", F.ceil(F.lit(P95) * n).cast("int") - 1).alias("p95"),
        F.get("v", n - 1).alias("max"),
    )


def file_distributions(observations: DataFrame) -> DataFrame:
    """One distribution per file and metric family."""
    keys = [*ENTITY_FILE, "family"]
    for key in keys:
        observations = observations.where(F.col(key).isNotNull())
    return bounded_distributions(observations, keys)


def module_distributions(observations: DataFrame) -> DataFrame:
    """One distribution per module and family, from the raw values of its files."""
    return distribution(observations, [*ENTITY_MODULE, "family"])


def with_empty(dist: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All entities; those without values get zeros, not NULL."""
    zero = {"count": F.lit(0).cast("long")}
    return entities.select(*keys).join(dist, list(keys), "left").select(
        *keys,
        *[F.coalesce(F.col(s), zero.get(s, F.lit(0.0))).alias(s) for s in STATS],
    )


def pack_distributions(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per entity: ``metrics`` (``family_agg`` to value) and ``distributions``.

    The lists gathered here hold one entry per metric family.
    """
    values = [s for s in STATS if s != "count"]
    metric_entries = F.array(
        *[F.struct(F.concat_ws("_", "family", F.lit(s)).alias("key"), F.col(s).alias("value")) for s in values]
    )
    entry = F.struct(F.col("family").alias("key"), F.struct(*STATS).alias("value"))
    return dist.groupBy(*keys).agg(
        F.map_from_entries(F.flatten(F.sort_array(F.collect_list(metric_entries)))).alias("metrics"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("distributions"),
    )


def measure_files(files: DataFrame) -> DataFrame:
    """Categorised files with their line counts; other suffixes are left out.

    ``files`` holds ``(version_id, module, relative_path, lines)``.
    """
    return files.withColumn("line_category_id", line_category("relative_path")).where(
        F.col("line_category_id").isNotNull()
    )


def line_counts(
    file_lines: DataFrame,
    categories: Sequence[str] = LINE_CATEGORIES,
    category: str = "line_category_id",
    lines: str = "lines",
    keys: Sequence[str] = ENTITY_MODULE,
) -> DataFrame:
    """Lines per category and in total, one column per category, per module."""
    sums = [
        F.coalesce(F.sum(F.when(F.col(category) == c, F.col(lines))), F.lit(0)).cast("long").alias(c)
        for c in categories
    ]
    total = F.coalesce(F.sum(F.when(F.col(category).isin(*categories), F.col(lines))), F.lit(0))
    return file_lines.groupBy(*keys).agg(*sums, total.cast("long").alias("total_lines"))


def roll_up_line_counts(per_file: DataFrame, categories: Sequence[str] = LINE_CATEGORIES) -> DataFrame:
    """Module line counts and the number of files, from line counts per file."""
    sums = [F.sum(c).alias(c) for c in (*categories, "total_lines")]
    return per_file.groupBy(*ENTITY_MODULE).agg(*sums, F.count(F.lit(1)).alias("file_count"))


def line_count_map(wide: DataFrame, categories: Sequence[str] = LINE_CATEGORIES) -> DataFrame:
    """The wide form with its categories as one ``line_counts`` map."""
    entries = [x for c in categories for x in (F.lit(c), F.col(c))]
    return wide.withColumn("line_counts", F.create_map(*entries)).drop(*categories)


def is_measured_python(path: str = "relative_path") -> Column:
    """Production Python: no test, no manifest."""
    return F.col(path).endswith(".py") & (file_name(path) != "__manifest__.py") & ~is_test_path(path)


def file_counts(files: DataFrame, error: str = "error") -> DataFrame:
    """Production Python files and parse errors per module; broken files count too."""
    measured = is_measured_python()
    return files.groupBy(*ENTITY_MODULE).agg(
        F.count_if(measured).alias("python_file_count"),
        F.count_if(measured & F.col(error).isNotNull()).alias("parse_error_count"),
    )


def line_density(nodes: DataFrame, keys: Sequence[str] = ENTITY_FILE) -> DataFrame:
    """Syntax nodes per physical line, from one row per node ``(…keys, line)``."""
    return nodes.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("value"))


def assemble_file_metrics(file_lines: DataFrame, dist: DataFrame) -> DataFrame:
    """Stored file rows: every categorised file, measured or not.

    ``dist`` is the long output of :func:`file_distributions`; unmeasured files
    get empty maps and zero counts.
    """
    keys = list(ENTITY_FILE)
    return _file_rows(file_lines.join(pack_distributions(dist, keys), keys, "left"))


def assemble_text_metrics(file_lines: DataFrame, dist: DataFrame, measured: Column) -> DataFrame:
    """:func:`assemble_file_metrics` where ``dist`` is known per text ``(content_sha, family, …)``.

    Texts are packed and meet the ``measured`` files by their hash: files are not shuffled
    to be counted, nor to meet a table of texts that is small.
    """
    packed = stored(pack_distributions(dist, ["content_sha"]), "packed")
    met = file_lines.where(measured).join(packed, "content_sha", "left")
    return _file_rows(met.unionByName(file_lines.where(~measured), allowMissingColumns=True))


def _file_rows(joined: DataFrame) -> DataFrame:
    keys = list(ENTITY_FILE)

    def counted(family: str) -> Column:
        n = F.try_element_at(F.col("distributions"), F.lit(family))["count"]
        return F.coalesce(n, F.lit(0)).cast("long")

    return joined.select(
        *keys,
        "line_category_id",
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"),
        F.create_map(
            F.lit("lines"), F.col("lines").cast("long"),
            F.lit("function_count"), counted("cyclomatic"),
            F.lit("jones_line_count"), counted("jones"),
        ).alias("line_counts"),
        F.coalesce(
            "distributions",
            F.create_map().cast("map<string,struct<count:bigint,mean:double,median:double,p95:double,max:double>>"),
        ).alias("distributions"),
    )


def measured_files(
    stretches: DataFrame, families: Sequence[str] = FAMILIES, category: str = "line_category_id", lines: str = "lines"
) -> DataFrame:
    """:func:`assemble_file_metrics` from stretches of files with one column per family, in one shuffle.

    A file has the lines of its stretches and the first of their categories. Each file
    bounds its own values, which are gathered and sorted where they are.
    """
    keys = list(ENTITY_FILE)
    gathered = stretches.groupBy(*keys).agg(
        F.min(category).alias("line_category_id"),
        F.sum(lines).cast("long").alias("lines"),
        *[F.sort_array(F.collect_list(F.col(f).cast("double"))).alias(f"_v_{f}") for f in families],
    )
    named = F.lit(True)
    for key in keys:
        named = named & F.col(key).isNotNull()

    def described(family: str) -> Column:
        v = F.col(f"_v_{family}")
        n = F.size(v)
        middle = F.get(v, F.floor((n + 1) / 2).cast("int") - 1) + F.get(v, F.floor(n / 2).cast("int"))
        return F.struct(
            n.cast("long").alias("count"),
            (F.aggregate(v, F.lit(0.0), lambda total, x: total + x) / n).alias("mean"),
            (middle / 2).alias("median"),
            F.get(v, F.ceil(F.lit(P95) * n).cast("int") - 1).alias("p95"),
            F.get(v, n - 1).alias("max"),
        )

    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.when(named & (F.size(f"_v_{f}") > 0), described(f)).alias("value")) for f in sorted(families)])
    packed = gathered.select(*keys, "line_category_id", "lines", F.filter(entries, lambda e: e["value"].isNotNull()).alias("_d"))
    metrics = F.transform("_d", lambda d: F.array(
        *[F.struct(F.concat_ws("_", d["key"], F.lit(s)).alias("key"), d["value"][s].alias("value")) for s in STATS if s != "count"]
    ))
    found = packed.select(
        *keys, "line_category_id", "lines", F.map_from_entries(F.flatten(metrics)).alias("metrics"), F.map_from_entries("_d").alias("distributions")
    )

    def counted(family: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("distributions"), F.lit(family))["count"], F.lit(0)).cast("long")

    return found.select(
        *keys,
        "line_category_id",
        "metrics",
        F.create_map(
            F.lit("lines"), F.col("lines"),
            F.lit("function_count"), counted("cyclomatic"),
            F.lit("jones_line_count"), counted("jones"),
        ).alias("line_counts"),
        "distributions",
    )


def assemble_module_aggregates(
    counts: DataFrame,
    dist: DataFrame,
    python_files: str | None = None,
    depends: DataFrame | None = None,
    families: Sequence[str] = FAMILIES,
) -> DataFrame:
    """Stored module rows from line counts, distributions, file counts and dependencies.

    A module without values has all-zero distributions for every family.
    ``python_files`` names the column of ``counts`` with the file count.
    """
    keys = list(ENTITY_MODULE)
    out = counts.join(pack_distributions(dist, keys).select(*keys, "distributions"), keys, "left")
    zero = F.struct(*[F.lit(0 if s == "count" else 0.0).cast(DISTRIBUTION[s].dataType).alias(s) for s in STATS])
    found = {f: F.coalesce(F.try_element_at("distributions", F.lit(f)), zero) for f in families}
    out = out.withColumn(
        "distributions", F.create_map(*[x for f, d in found.items() for x in (F.lit(f), d)])
    ).withColumn(
        "metrics",
        F.create_map(
            *[
                x
                for f in families
                for s in STATS
                if s != "count"
                for x in (F.lit(f"{f}_{s}"), F.try_element_at("distributions", F.lit(f))[s])
            ]
        ),
    )
    if python_files is not None:
        n = F.coalesce(F.col(python_files), F.lit(0)).cast("double")
        out = out.withColumn("metrics", F.map_concat("metrics", F.create_map(F.lit("python_file_count"), n)))
    none = F.array().cast("array<string>")
    if depends is not None:
        out = out.join(depends.select(*keys, "manifest_depends"), keys, "left")
    else:
        out = out.withColumn("manifest_depends", none)
    return out.select(
        *keys,
        "total_lines",
        "metrics",
        "line_counts",
        "distributions",
        F.coalesce("manifest_depends", none).alias("manifest_depends"),
    )


def combined_metric(values: Sequence[Column]) -> Column:
    """Mean of the selected values that are present; NULL when none is."""
    present = F.filter(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(present) > 0, total / F.size(present))


def run_outcome(flags: DataFrame, run: str = "run_id") -> DataFrame:
    """Succeeded / failed / processed per run, from one row per (run, version).

    ``has_metrics`` and ``failures`` say what a version produced: it failed only
    when it has failures and no metrics.
    """
    failed = (F.col("failures") > 0) & ~F.col("has_metrics")
    return flags.groupBy(run).agg(
        F.count_if(~failed).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.count(F.lit(1)).alias("processed"),
    )
