"""Complexity of Python files: per function, per line, and what failed to parse.

Cyclomatic values follow McCabe: one plus the decision points of a function's
body, nested functions counted on their own. Cognitive values follow the
published definition by Campbell (2018): nested functions count towards the
function around them, recursion is not counted.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmetrics.extract.contents import FILE, distinct_contents, extract, hashed, on_files, with_sha
from histmetrics.functions.text import file_name
from histmetrics.operators.measures import (
    ENTITY_MODULE,
    bounded_distributions,
    coarsen,
    distribution_of,
    is_measured_python,
)
from histmetrics.session import stored

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOP = (ast.For, ast.AsyncFor, ast.While)
UNNAMED = "<file>"
COLUMNS = "family string, value double, n bigint, error string"


def functions_in(nodes: Iterable[ast.AST], nested: bool = True, classes: bool = True) -> Iterator[ast.AST]:
    """Functions and methods of outer classes, with the functions nested in them if asked for."""
    for node in nodes:
        if isinstance(node, FUNCTION):
            yield node
            if nested:
                yield from functions_in(node.body, nested, classes=False)
        elif isinstance(node, ast.ClassDef):
            if classes:
                yield from functions_in(node.body, nested, classes=False)
        else:
            yield from functions_in(ast.iter_child_nodes(node), nested, classes)


def _decisions(node: ast.AST) -> int:
    if isinstance(node, (ast.If, ast.IfExp, ast.Assert)):
        return 1
    if isinstance(node, LOOP):
        return 2 if node.orelse else 1
    if isinstance(node, (ast.Try, ast.TryStar)):
        return len(node.handlers) + bool(node.orelse)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, ast.Match):
        open_case = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in node.cases)
        return len(node.cases) - open_case
    return 0


def cyclomatic(function: ast.AST) -> int:
    total, todo = 1, list(function.body)
    while todo:
        node = todo.pop()
        if isinstance(node, (*FUNCTION, ast.ClassDef)):
            continue
        total += _decisions(node)
        todo.extend(ast.iter_child_nodes(node))
    return total


def cognitive(function: ast.AST) -> int:
    return sum(_effort(child, 0, None) for child in function.body)


def _effort(node: ast.AST, depth: int, around: ast.AST | None) -> int:
    def inner(nodes: Iterable[ast.AST], level: int) -> int:
        return sum(_effort(n, level, node) for n in nodes)

    if isinstance(node, ast.If):
        is_elif = isinstance(around, ast.If) and around.orelse == [node] and _continues(around, node)
        own = 1 if is_elif else 1 + depth
        level = depth if is_elif else depth + 1
        total = own + inner([node.test], depth) + inner(node.body, level)
        if node.orelse:
            follow = len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and _continues(node, node.orelse[0])
            total += inner(node.orelse, level) if follow else 1 + inner(node.orelse, level)
        return total
    if isinstance(node, LOOP):
        head = [node.test] if isinstance(node, ast.While) else [node.target, node.iter]
        return (
            1 + depth + inner(head, depth) + inner(node.body, depth + 1)
            + (1 + inner(node.orelse, depth + 1) if node.orelse else 0)
        )
    if isinstance(node, ast.ExceptHandler):
        return 1 + depth + inner(node.body, depth + 1)
    if isinstance(node, ast.IfExp):
        return 1 + depth + inner(ast.iter_child_nodes(node), depth + 1)
    if isinstance(node, ast.Match):
        return 1 + depth + inner([node.subject], depth) + inner(node.cases, depth + 1)
    if isinstance(node, ast.BoolOp):
        same = isinstance(around, ast.BoolOp) and type(around.op) is type(node.op)
        return (0 if same else 1) + inner(node.values, depth)
    if isinstance(node, (*FUNCTION, ast.Lambda)):
        body = node.body if isinstance(node.body, list) else [node.body]
        return inner(body, depth + 1)
    return inner(ast.iter_child_nodes(node), depth)


def _continues(outer: ast.If, branch: ast.If) -> bool:
    """``elif`` starts in the column of its ``if``; an ``if`` inside ``else:`` is further in."""
    return outer.col_offset == branch.col_offset


def nodes_per_line(tree: ast.AST) -> Counter:
    lines: Counter = Counter()
    for node in ast.walk(tree):
        if not isinstance(node, (ast.Module, ast.expr_context)) and getattr(node, "lineno", 0) > 0:
            lines[node.lineno] += 1
    return lines


def _counted(family: str, values: Iterable[int]) -> Iterator[tuple]:
    for value, n in Counter(values).items():
        yield family, float(value), n, None


def read_complexity(source: str | None) -> list[tuple]:
    """``(family, value, n, error)``: distinct values with their counts, or one error."""
    if source is None:
        return [(None, None, None, "cannot decode file as UTF-8")]
    try:
        tree = ast.parse(source, filename=UNNAMED)
        return [
            *_counted("cyclomatic", map(cyclomatic, functions_in(tree.body))),
            *_counted("cognitive", map(cognitive, functions_in(tree.body, nested=False))),
            *_counted("jones", nodes_per_line(tree).values()),
        ]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [(None, None, None, str(error))]


def read_lines(source: str | None) -> list[tuple]:
    """``(line, n)``: syntax nodes that start on each line."""
    try:
        return list(nodes_per_line(ast.parse(source or "", filename=UNNAMED)).items())
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def content_values(files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``(content_sha, family, value, n, error)`` for production Python files, once per distinct text."""
    return extract(distinct_contents(files, is_measured_python(), keys), read_complexity, COLUMNS)


def _read_once(files: DataFrame, values: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (their keys, if they had to be hashed for it) and the values of their texts, as a table of known size."""
    if values is not None:
        return files, values
    keys = hashed(files, is_measured_python())
    return keys, stored(content_values(files, keys), "values")


def _known(values: DataFrame) -> DataFrame:
    return values.where(F.col("error").isNull()).drop("error")


def function_complexity(files: DataFrame) -> DataFrame:
    """Value counts per file and family: ``(…file, family, value, n)``."""
    keys, values = _read_once(files)
    return on_files(_known(values), keys, is_measured_python()).select(*FILE, "family", "value", "n")


def line_density(files: DataFrame) -> DataFrame:
    """Syntax nodes per physical line of every production Python file."""
    keys = hashed(files, is_measured_python())
    lines = stored(extract(distinct_contents(files, is_measured_python(), keys), read_lines, "line int, n bigint"), "lines")
    return on_files(lines, keys, is_measured_python()).select(*FILE, "line", F.col("n").alias("value"))


def text_distributions(values: DataFrame) -> DataFrame:
    """``(content_sha, family, …)``: the five numbers of each text's values."""
    return bounded_distributions(_known(values), ["content_sha", "family"], "n")


def python_file_distributions(files: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Distributions per file: computed once per content, then joined to its files.

    A text bounds its own values, so they are ranked where they are grouped. ``values``
    is the output of :func:`content_values`, if it is there already.
    """
    keys, values = _read_once(files, values)
    return on_files(text_distributions(values), keys, is_measured_python()).drop("content_sha")


def python_module_distributions(files: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Distributions per module from raw values; copies of a text are counted, not repeated."""
    found, values = _read_once(files, values)
    found = with_sha(found)
    same = found.where(is_measured_python()).groupBy(*ENTITY_MODULE, "content_sha")
    repeated = same.agg(F.count(F.lit(1)).alias("copies"))
    weighted = repeated.join(_known(values), "content_sha").withColumn("n", F.col("n") * F.col("copies"))
    keys = [*ENTITY_MODULE, "family"]
    return distribution_of(coarsen(weighted, keys), keys)


def failures(files: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row per Python file that could not be measured; the file itself stays counted."""
    keys, values = _read_once(files, values)
    errors = values.where(F.col("error").isNotNull()).select("content_sha", "error")
    found = on_files(errors, keys, is_measured_python())
    named = F.replace(
        F.col("error"), F.lit(f"({UNNAMED}, "), F.concat(F.lit("("), file_name("relative_path"), F.lit(", "))
    )
    return found.select(
        "version_id", F.concat_ws("/", "module", "relative_path").alias("file_path"), named.alias("error_text")
    )


def apply_error_policy(failed: DataFrame, versions: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Versions with their outcome; a strict run raises at the first version that failed.

    ``failed`` holds version-level errors ``(version_id, error_text)``.
    """
    errors = failed.groupBy("version_id").agg(F.min("error_text").alias("error_text"))
    out = versions.join(errors, "version_id", "left").withColumn("failed", F.col("error_text").isNotNull())
    if not fail_fast:
        return out
    first = versions.join(errors, "version_id").agg(F.min_by("error_text", "version_order").alias("error_text"))
    stop = first.select(
        F.when(F.col("error_text").isNotNull(), F.raise_error(F.col("error_text")).cast("boolean")).otherwise(F.lit(True))
    )
    return out.where(stop.scalar())
