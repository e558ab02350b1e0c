"""Columns over paths and texts. All of them stay inside JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from histmetrics.functions.catalog import SUFFIX_CATEGORY

# Ids start where a word starts, so a long run of letters is read once and not
# once per letter.
EXTERNAL_ID = r"(?<![a-zA-Z0-9_])([a-zA-Z0-9_]++\.[a-zA-Z0-9_]++)"
PERCENT_ID = r"%\(([a-zA-Z0-9_]+\.[a-zA-Z0-9_]+)\)d"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


# Folders and names that make a file a test.
TEST_FILE = (
    r"(^|/)(tests|__tests__)(/|$)"
    r"|(^|/)(?i:test_[^/]*)$"
    r"|(?i:_test[.]py|[.]test[.]js|[.]spec[.]js)$"
)


def is_test_path(path: Column | str) -> Column:
    """In a ``tests`` folder, or named like a test."""
    low = F.lower(_col(path))  # few paths hold a word that the pattern needs
    return (F.contains(low, F.lit("test")) | F.contains(low, F.lit("spec"))) & _col(path).rlike(TEST_FILE)


def line_category(path: Column | str) -> Column:
    """Category by the last suffix; only Python is split into code and tests."""
    low = F.lower(_col(path))
    category = F.lit(None).cast("string")
    for suffix, name in reversed(SUFFIX_CATEGORY.items()):  # no suffix ends another
        found = F.when(is_test_path(path), F.lit("python_test_lines")).otherwise(F.lit(name)) if name == "python_lines" else F.lit(name)
        category = F.when(low.endswith(suffix), found).otherwise(category)
    return category


def line_count(text: Column | str) -> Column:
    """Lines as text-mode iteration counts them: any newline style, open last line."""
    given = _col(text)
    unix = F.when(F.contains(given, F.lit("\r")), F.regexp_replace(given, "\r\n?", "\n")).otherwise(given)
    breaks = F.size(F.split(unix, "\n")) - 1
    open_end = (unix != "") & ~unix.endswith("\n")
    return F.when(given.isNotNull(), (breaks + open_end.cast("int")).cast("long"))


def top_folder(path: Column | str) -> Column:
    p = _col(path)
    return F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", 1)).otherwise(F.lit("."))


def split_entity_path(name: Column | str) -> Column:
    """``module/relative/path`` to a struct; NULL unless both parts are present."""
    n = _col(name)
    cut = F.instr(n, "/")
    module, rest = F.substr(n, F.lit(1), cut - 1), F.substr(n, cut + 1)
    return F.when(
        (cut > 1) & (F.length(rest) > 0),
        F.struct(module.alias("module"), rest.alias("relative_path")),
    )


def external_ids(text: Column | str) -> Column:
    """Every ``a.b`` in a text, in order, repeats kept."""
    return F.regexp_extract_all(_col(text), F.lit(EXTERNAL_ID), F.lit(1))


def percent_ids(text: Column | str) -> Column:
    """Every ``%(a.b)d`` in a text, in order, repeats kept."""
    return F.regexp_extract_all(_col(text), F.lit(PERCENT_ID), F.lit(1))


def id_module(external_id: Column | str) -> Column:
    return F.substring_index(_col(external_id), ".", 1)


def line_of(text: Column | str, snippet: Column | str, start: Column | int = 1) -> Column:
    """1-based line of the first occurrence at or after ``start``; 0 if there is none."""
    t, s = _col(text), _col(snippet)
    at = F.position(s, t, F.lit(start) if isinstance(start, int) else start)
    before = F.substr(t, F.lit(1), at - 1)
    newlines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when((at > 0) & (F.length(s) > 0), newlines + 1).otherwise(F.lit(0))


def title_case(text: Column | str) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the rest."""
    chars = F.split(_col(text), "")

    def one(c: Column, i: Column) -> Column:
        after_letter = (i > 0) & F.coalesce(F.get(chars, i - 1).rlike("^[A-Za-z]$"), F.lit(False))
        return F.when(after_letter, F.lower(c)).otherwise(F.upper(c))

    return F.array_join(F.transform(chars, one), "")
