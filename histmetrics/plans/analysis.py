"""From files to the stored tables in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmetrics import schemas
from histmetrics.extract import classes, complexity, references
from histmetrics.extract.contents import FILE, chosen_texts, extract_kinds, with_sha
from histmetrics.functions.text import line_category, line_count
from histmetrics.operators import graph, measures, ordering
from histmetrics.plans import reads
from histmetrics.session import stored
from histmetrics.sources.tables import conform


MANIFEST = "__manifest__.py"
PYTHON, XML, CSV, DECLARED = "python", "xml", "csv", "manifest"
READERS = {
    PYTHON: (complexity.read_complexity, complexity.COLUMNS),
    XML: (references.read_xml, references.XML_COLUMNS),
    CSV: (references.read_csv, references.CSV_COLUMNS),
    DECLARED: (references.read_manifest_once, references.MANIFEST_COLUMNS),
}


def select_files(
    files: DataFrame,
    prefixes: Sequence[str] = (),
    include: Sequence[str] = (),
    all_modules: bool = False,
    policy: str = "keep_first",
    prefer: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Files of the modules to analyse, and the duplicates that were skipped.

    ``files`` also holds ``path``, the module's folder, and ``seq``, the order in which
    the scan meets folders. A module is a folder with a manifest whose name is in scope; of
    folders with the same name one wins (see :func:`ordering.resolve_duplicates`). Files
    that lead out of their folder are left out. Only names are shuffled: manifests are
    looked for once, and the winners are a table of known size that goes to the files.
    """
    named = reads.scope_modules(files, prefixes, include, all_modules)
    folder = F.concat(F.lit("/"), F.trim("path", F.lit("/")), F.lit("/"))
    whole = F.concat(folder, "relative_path")
    # Only a path with an empty, "." or ".." part is taken apart.
    inside = F.when(~whole.rlike(r"/[.]{0,2}(/|$)"), F.lit(True)).otherwise(F.startswith(reads.collapse_path(whole), folder))
    found = named.where(F.col("relative_path") == MANIFEST).select("version_id", "module", "path", "seq")
    manifests = stored(found, "manifests")
    kept, skipped = ordering.resolve_duplicates(manifests, policy, prefer)
    winners = stored(kept.select("version_id", "module", "path"), "modules")
    chosen = named.where(inside).join(winners, ["version_id", "module", "path"], "left_semi")
    return chosen.drop("path", "seq"), skipped


def analyze_files(
    files: DataFrame, count_mode: str = "presence", python_links: bool = False
) -> tuple[dict[str, DataFrame], DataFrame]:
    """File, module and edge rows of some versions' files, and what could not be read.

    ``files`` holds ``(version_id, module, relative_path, content)``. Modules are
    those with files. Edges come from manifests, XML and security CSV files, and
    from Python classes if ``python_links`` is set.
    """
    # Texts are gone through twice: to say of each file what it is, and to read one of each
    # text. All else is counted on narrow tables, whose size the planner knows.
    kind = F.when(references.is_xml(), XML).when(references.is_security_csv(), CSV).when(references.is_manifest(), DECLARED)
    keys = stored(
        with_sha(files).select(
            *FILE, "content_sha", line_count("content").alias("_lines"), line_category("relative_path").alias("line_category_id"),
            kind.when(measures.is_measured_python(), PYTHON).alias("text_kind"),
        ),
        "files",
    )
    found = extract_kinds(chosen_texts(files, keys), READERS)
    values, python = found[PYTHON], F.col("text_kind").eqNullSafe(PYTHON)
    modules = stored(keys.select("version_id", "module").distinct(), "modules")
    sized = keys.where(F.col("line_category_id").isNotNull()).withColumn("lines", F.coalesce("_lines", F.lit(0)))
    file_rows = measures.assemble_text_metrics(sized, complexity.text_distributions(values), python)

    counts = measures.line_count_map(measures.line_counts(sized))
    measured = keys.where(python).groupBy("version_id", "module").agg(F.count(F.lit(1)).alias("python_files"))
    counts = counts.join(measured, ["version_id", "module"], "left")
    manifests = stored(references.manifests(keys, found[DECLARED]), "manifests")
    module_rows = measures.assemble_module_aggregates(
        counts, complexity.python_module_distributions(keys, values), "python_files", graph.in_scope_depends(manifests, modules)
    )

    declared = graph.link_manifests(manifests, modules).select(*graph.EDGE, "kind", F.lit(1).cast("long").alias("n"))
    facts = graph.all_edge_facts(
        declared,
        references.reference_counts(keys, found[XML], found[CSV], each=count_mode != "presence"),
        *([classes.python_links(files, modules)] if python_links else []),
    )
    edges = graph.build_coupling_edges(facts, modules, count_mode, weight="n")
    errors = {k: stored(found[k].where(F.col("error").isNotNull()).select("content_sha", "error"), "errors") for k in (PYTHON, XML, CSV)}
    failed = complexity.failures(keys, errors[PYTHON]).unionByName(references.xml_failures(keys, errors[XML]))
    failed = failed.unionByName(references.csv_failures(keys, errors[CSV], "_lines"))
    tables = {"file_metric": file_rows, "module_aggregate": module_rows, "coupling_edge": edges}
    return tables, conform(failed, schemas.FAILURE)
