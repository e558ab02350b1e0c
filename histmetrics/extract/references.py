"""Reference facts from XML, security CSV and manifests."""

from __future__ import annotations

import ast
import csv
import io
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics.extract.contents import FILE, distinct_contents, extract, hashed, on_files, with_sha
from histmetrics.functions.text import EXTERNAL_ID, PERCENT_ID, file_name, id_module
from histmetrics.functions.validate import MODULE
from histmetrics.session import stored

# The record model and the folder that make a reference a security one.
RULE_MODEL = "ir.rule"
SECURITY_FOLDER = "security"


def is_xml() -> Column:
    return F.col("relative_path").endswith(".xml")


def is_security_csv() -> Column:
    return F.col("relative_path").startswith(f"{SECURITY_FOLDER}/") & F.col("relative_path").endswith(".csv")


_ID, _PERCENT = re.compile(EXTERNAL_ID), re.compile(PERCENT_ID)


class _Finder:
    """Lines of repeated snippets: each search goes on where the last one ended."""

    def __init__(self, text: str) -> None:
        self.text, self.ends = text, {}

    def line(self, snippet: str) -> int:
        at = self.text.find(snippet, self.ends.get(snippet, 0))
        if at < 0:
            at = self.text.find(snippet)
        if at < 0 or not snippet:
            return 0
        self.ends[snippet] = at + len(snippet)
        return self.text.count("\n", 0, at) + 1


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def read_xml(text: str | None) -> list[tuple]:
    """``(kind, xml_id, line, detail, error)`` of a text's references.

    ``%(a.b)d`` by lines first, in malformed texts too; then those of elements, in
    document order, or the error.
    """
    if text is None:
        return [(None, None, None, None, "cannot decode file as UTF-8")]
    out = [
        ("xml_percent_ref", found.group(1), number, f"%({found.group(1)})d", None)
        for number, line in enumerate(text.split("\n"), start=1)
        for found in _PERCENT.finditer(line)
    ]
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError) as error:
        return [*out, (None, None, None, None, str(error))]
    find, todo = _Finder(text), [(root, None)]
    while todo:
        element, model = todo.pop()
        if _local(element.tag) == "record":
            model = element.get("model")
        ref = element.get("ref")
        if _local(element.tag) == "field":
            xml_id = ref or (element.text or "").strip()
            if "." in xml_id:
                if element.get("name") == "inherit_id":
                    out.append(("xml_inherit_id", xml_id, find.line(xml_id), f"inherit_id -> {xml_id}", None))
                if element.get("name") == "model_id" and model == RULE_MODEL:
                    told = f"{RULE_MODEL} model_id -> {xml_id}"
                    out.append(("security_ir_rule_model_ref", xml_id, find.line(xml_id), told, None))
        if ref and "." in ref:
            kind = "security_ir_rule_ref" if model == RULE_MODEL else "xml_ref"
            out.append((kind, ref, find.line(ref), f"ref -> {ref}", None))
        todo.extend((child, model) for child in reversed(element))
    return out


XML_COLUMNS = "kind string, xml_id string, line int, detail string, error string"
CSV_COLUMNS = "line int, xml_id string, error string"


def xml_found(files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """All that is found in XML texts, once per distinct text; rows are narrow, texts stay where they are."""
    return extract(
        distinct_contents(files, is_xml(), keys),
        read_xml,
        XML_COLUMNS,
    )


def _read_once(files: DataFrame, found: DataFrame | None, where: Column, read: Callable) -> tuple[DataFrame, DataFrame]:
    """Files (their keys, if they had to be hashed for it) and what was found in their texts, as a table of known size."""
    if found is not None:
        return files, found
    keys = hashed(files, where)
    return keys, stored(read(files, keys), "found")


def _as_facts(found: DataFrame) -> DataFrame:
    return found.select(
        "version_id",
        F.col("module").alias("source"),
        id_module("xml_id").alias("target"),
        "kind",
        F.col("relative_path").alias("file_path"),
        "line",
        "detail",
    )


def _in_security() -> Column:
    return F.array_contains(F.split("relative_path", "/"), SECURITY_FOLDER)


def _placed_kind(secure: Column) -> Column:
    return F.when((F.col("kind") == "xml_ref") & secure, "security_xml_ref").otherwise(F.col("kind"))


def xml_reference_facts(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """All references of XML files, not yet limited to analysed modules.

    Plain references in a ``security`` folder of the module are security ones.
    ``found`` is the output of :func:`xml_found`, if it is there already.
    """
    keys, found = _read_once(files, found, is_xml(), xml_found)
    told = found.where(F.col("error").isNull()).drop("error")
    return _as_facts(on_files(told, keys, is_xml()).withColumn("kind", _placed_kind(_in_security())))


def xml_failures(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    keys, told = _read_once(files, found, is_xml(), xml_found)
    errors = told.where(F.col("error").isNotNull()).select("content_sha", "error")
    return on_files(errors, keys, is_xml()).select(
        "version_id",
        F.concat_ws("/", "module", "relative_path").alias("file_path"),
        F.col("error").alias("error_text"),
    )


def read_csv(text: str | None) -> Iterator[tuple]:
    """``(line, xml_id, error)``: ids in every cell after the header; records count, from 2.

    A record that cannot be read ends the file with an error.
    """
    csv.field_size_limit(max(csv.field_size_limit(), len(text or "")))
    records = csv.reader(io.StringIO(text or "", newline=""))
    number = 1
    try:
        filled = (r for r in records if r)
        next(filled, None)
        for number, record in enumerate(filled, start=2):
            for cell in record:
                for found in _ID.finditer(cell):
                    yield number, found.group(1), None
    except csv.Error as error:
        yield number + 1, None, f"record {number + 1}: {error}"


def csv_found(files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Ids and errors of security CSV texts, once per distinct text."""
    return extract(distinct_contents(files, is_security_csv(), keys), read_csv, CSV_COLUMNS)


def csv_failures(files: DataFrame, told: DataFrame | None = None, text: str = "content") -> DataFrame:
    """Security CSV files with a record that cannot be read, and those that cannot be decoded: their ``text`` is NULL."""
    errors = (csv_found(files) if told is None else told).where(F.col("error").isNotNull()).select("content_sha", "error")
    undecoded = with_sha(files).where(is_security_csv() & F.col(text).isNull()).select(*FILE, F.lit("cannot decode file as UTF-8").alias("error"))
    found = on_files(errors, files, is_security_csv()).select(*FILE, "error").unionByName(undecoded)
    return found.select(
        "version_id", F.concat_ws("/", "module", "relative_path").alias("file_path"), F.col("error").alias("error_text")
    )


def csv_reference_facts(files: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """References of the security CSV files, not yet limited to analysed modules."""
    keys, told = _read_once(files, told, is_security_csv(), csv_found)
    found = told.where(F.col("error").isNull()).drop("error")
    located = on_files(found, keys, is_security_csv()).withColumn("kind", F.lit("security_csv_ref"))
    return _as_facts(located.withColumn("detail", F.concat(F.lit("security csv ref -> "), F.col("xml_id"))))


def _counts(told: DataFrame, files: DataFrame, secure: Column, each: bool) -> DataFrame:
    """References of texts counted per file's module, target and kind, without a row per file and reference.

    Texts that say the same of the same modules stand for each other: files are counted by
    them, and only these few counts are spread over what is said.
    """
    target = id_module("xml_id").alias("target")
    n = (F.count(F.lit(1)) if each else F.max(F.lit(1))).cast("long").alias("n")
    once = told.where(F.col("error").isNull()).groupBy("content_sha", "kind", target).agg(n)
    gathered = F.sort_array(F.collect_list(F.struct("kind", "target", "n"))).alias("said")
    said = stored(once.groupBy("content_sha").agg(gathered), "said")
    alike = stored(said.groupBy("said").agg(F.min("content_sha").alias("like")), "alike")
    texts = stored(said.join(alike, "said").select("content_sha", "like"), "like")
    met = files.join(texts, "content_sha").groupBy("version_id", F.col("module").alias("source"), secure.alias("_secure"), "like")
    counted = stored(met.agg(F.count(F.lit(1)).alias("copies")), "counted")
    spread = counted.join(alike, "like").select("version_id", "source", "_secure", "copies", F.explode("said").alias("r"))
    told = spread.select("version_id", "source", "_secure", "r.target", "r.kind", (F.col("r.n") * F.col("copies")).alias("n"))
    return told.withColumn("kind", _placed_kind(F.col("_secure"))).drop("_secure")


def reference_counts(files: DataFrame, xml: DataFrame, csv: DataFrame, each: bool = True) -> DataFrame:
    """``(version_id, source, target, kind, n)``: :func:`xml_reference_facts` and :func:`csv_reference_facts`, counted.

    ``files`` holds the files' keys and hashes, ``xml`` and ``csv`` what was found in their
    texts. Unless ``each`` is set, a text counts once for each target and kind.
    """
    named = csv.withColumn("kind", F.lit("security_csv_ref"))
    from_xml = _counts(xml, files.where(is_xml()), _in_security(), each)
    return from_xml.unionByName(_counts(named, files.where(is_security_csv()), F.lit(True), each))


# --- manifests --------------------------------------------------------------------

_NAME = re.compile(MODULE)
# Accepted assignment targets and failure reasons.
_TARGETS = ("manifest", "__manifest__")
_UNREADABLE = "literal_eval_failed"
_ABSENT = "no_manifest_assignment"


def read_manifest(source: str | None) -> tuple[list[str], str | None]:
    """Valid dependency names of the first top-level dict, or the reason there is none."""
    try:
        body = ast.parse(source or "").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], _UNREADABLE
    for statement in body:
        if isinstance(statement, ast.Assign):
            if not any(isinstance(t, ast.Name) and t.id in _TARGETS for t in statement.targets):
                continue
        elif not isinstance(statement, ast.Expr):
            continue
        try:
            value = ast.literal_eval(statement.value)
        except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
            continue
        if isinstance(value, dict):
            listed = value.get("depends", [])
            names = listed if isinstance(listed, (list, tuple, set, frozenset)) else []
            return sorted({n for n in names if isinstance(n, str) and _NAME.match(n)}), None
    return [], _ABSENT


MANIFEST_COLUMNS = "depends array<string>, reason string"


def read_manifest_once(source: str | None) -> list[tuple]:
    return [read_manifest(source)]


_PARSED = T.StructType(
    [T.StructField("depends", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())]
)


@F.pandas_udf(_PARSED)
def manifest_depends(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_manifest(s) for s in source], columns=["depends", "reason"])


def is_manifest() -> Column:
    return file_name("relative_path") == "__manifest__.py"


def manifests(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """``(version_id, module, relative_path, depends, reason)`` of every manifest file.

    ``parsed`` is what was found in their texts, if it is there already.
    """
    chosen = with_sha(files).where(is_manifest())
    if parsed is not None:
        return chosen.select(*FILE, "content_sha").join(parsed, "content_sha").select(*FILE, "depends", "reason")
    parsed = distinct_contents(chosen).select("content_sha", manifest_depends("content").alias("m"))
    return chosen.select(*FILE, "content_sha").join(parsed, "content_sha").select(*FILE, "m.depends", "m.reason")


