"""One extraction per distinct text, where the text lies.

The same blob sits in many versions. One file per content hash is chosen on narrow
columns; its text is read in place by small per-text Python helpers inside
``mapInPandas``, and the facts are joined back to the files that hold that text. File
keys (version, module, path) are unique and not NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histmetrics.session import stored

FILE = ("version_id", "module", "relative_path")


def with_sha(files: DataFrame) -> DataFrame:
    """Files with a content hash; those whose text could not be decoded share an empty one."""
    if "content_sha" in files.columns:
        return files
    return files.withColumn("content_sha", F.coalesce(F.sha2("content", 256), F.lit("")))


def hashed(files: DataFrame, where: Column | None = None) -> DataFrame:
    """``(version_id, module, relative_path, content_sha)`` as a written table, so texts are hashed once.

    It stands for the files wherever their texts are not asked for.
    """
    chosen = with_sha(files if where is None else files.where(where))
    return stored(chosen.select(*FILE, "content_sha"), "hashed")


def distinct_contents(files: DataFrame, where: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``(content_sha, content)`` once per hash, from the file that comes first by its key.

    The choice is a written table, so the planner knows its size: while it is small it is
    broadcast to the texts and no text leaves its place; beyond that, chosen texts are
    found by a join on the file keys. ``keys`` is the output of :func:`hashed` for these
    files, if it is there already.
    """
    chosen = files if where is None else files.where(where)
    number = F.xxhash64(*FILE)
    told = with_sha(chosen) if keys is None else keys
    if keys is not None:
        # Numbers are found without sorting; where two files of a text share one, the first by its key is taken.
        least = stored(keys.groupBy("content_sha").agg(F.min(number).alias("_number")), "least")
        told = keys.withColumn("_number", number).join(least, ["content_sha", "_number"], "left_semi")
    first = told.groupBy("content_sha").agg(F.min(F.struct(*FILE)).alias("_file"))
    kept = stored(first.select("content_sha", "_file.*"), "chosen")
    if keys is None or "content_sha" in files.columns:
        chosen = with_sha(chosen)
        return chosen.join(kept, [*FILE, "content_sha"], "left_semi").select("content_sha", "content")
    return _met(chosen, kept).select("content_sha", "content")


def _met(files: DataFrame, kept: DataFrame) -> DataFrame:
    """The columns of ``kept`` and the text of each of its files.

    The join is on the files' numbers. Ranges of one value are no join keys: only for the
    files that meet are names compared and texts hashed again.
    """
    number = F.xxhash64(*FILE)
    again = F.coalesce(F.sha2("content", 256), F.lit(""))
    others = [c for c in kept.columns if c not in FILE]
    asked = kept.select(*others, number.alias("_number"), *[F.col(c).alias(f"_{c}") for c in FILE])
    met = files.select(*FILE, "content", number.alias("_number")).join(asked, "_number")
    for c in FILE:
        met = met.where(F.col(c).between(F.col(f"_{c}"), F.col(f"_{c}")))
    return met.where(F.col("content_sha").between(again, again)).select(*others, "content")


def chosen_texts(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``(text_kind, content_sha, content)`` once per kind and hash, for all kinds in one go over the texts.

    ``keys`` is a written table of the files with their hash and ``text_kind``, which is
    NULL where a text is not asked for.
    """
    number = F.xxhash64(*FILE)
    text = ["text_kind", "content_sha"]
    known = keys.where(F.col("text_kind").isNotNull())
    least = stored(known.groupBy(*text).agg(F.min(number).alias("_number")), "least")
    told = known.withColumn("_number", number).join(least, [*text, "_number"], "left_semi")
    first = told.groupBy(*text).agg(F.min(F.struct(*FILE)).alias("_file"))
    kept = stored(first.select(*text, "_file.*"), "chosen")
    if "content_sha" in files.columns:
        return files.select(*FILE, "content_sha", "content").join(kept, [*FILE, "content_sha"]).select(*text, "content")
    return _met(files, kept).select(*text, "content")


def extract(contents: DataFrame, read: Callable[[str], Iterable[tuple]], columns: str) -> DataFrame:
    """Rows of ``read(text)`` per content, with the hash in front.

    ``columns`` is the DDL of the produced columns. Rows are yielded per Arrow
    batch of texts, so memory follows the batch and not the partition.
    """
    names = [part.strip().split(" ")[0] for part in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (sha, *row)
                for sha, text in zip(batch["content_sha"], batch["content"])
                for row in read(text)
            ]
            yield pd.DataFrame(rows, columns=["content_sha", *names], dtype=object)

    return contents.mapInPandas(run, f"content_sha string, {columns}")


def extract_kinds(texts: DataFrame, readers: dict[str, tuple[Callable[[str], Iterable[tuple]], str]]) -> dict[str, DataFrame]:
    """:func:`extract` for texts of several kinds, each with its reader and columns, in one go and as one written table.

    Columns of the same name must have the same type.
    """
    names = {k: [part.strip().split(" ")[0] for part in columns.split(",")] for k, (_, columns) in readers.items()}
    types = dict(part.strip().split(" ") for _, columns in readers.values() for part in columns.split(","))
    places = {k: [list(types).index(n) for n in own] for k, own in names.items()}
    reads = {k: read for k, (read, _) in readers.items()}
    width, head = len(types), ["text_kind", "content_sha"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, sha, text in zip(batch["text_kind"], batch["content_sha"], batch["content"]):
                for found in reads[kind](text):
                    row = [None] * width
                    for place, value in zip(places[kind], found):
                        row[place] = value
                    rows.append((kind, sha, *row))
            yield pd.DataFrame(rows, columns=[*head, *types], dtype=object)

    ddl = ", ".join(f"{n} {t}" for n, t in types.items())
    found = stored(texts.mapInPandas(run, f"text_kind string, content_sha string, {ddl}"), "found")
    return {k: found.where(F.col("text_kind") == k).select("content_sha", *own) for k, own in names.items()}


def on_files(facts: DataFrame, files: DataFrame, where: Column | None = None) -> DataFrame:
    """Facts of a content at every file that holds it."""
    chosen = with_sha(files)
    if where is not None:
        chosen = chosen.where(where)
    return chosen.select(*FILE, "content_sha").join(facts, "content_sha")


def copies(files: DataFrame, where: Column) -> DataFrame:
    """Files of one module with the same text as one row: its last path, and how many there are."""
    return (
        with_sha(files)
        .where(where)
        .groupBy("version_id", "module", "content_sha")
        .agg(F.max("relative_path").alias("relative_path"), F.count(F.lit(1)).alias("n"))
    )
