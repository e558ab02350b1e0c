"""File trees: one folder per version, one per module below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histmetrics.functions.text import line_count
from histmetrics.session import folder_names

LISTING = "spark.sql.sources.parallelPartitionDiscovery.threshold"


def read_file_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``<root>/<version>/<module>/<relative path>`` as one row per file.

    ``content`` is NULL when the bytes are no UTF-8; only then ``raw`` keeps them. The
    driver lists the root alone; the version folders are listed by tasks, and files are
    dealt to readers by their size.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/").removeprefix("file://") + "/"
    tail = F.substring_index(F.col("path"), base, -1)
    rest = F.regexp_replace(tail, "^[^/]*/", "")
    folders = [f"{root.rstrip('/')}/{name}" for name in folder_names(spark, root) if not name.startswith(("_", "."))]
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, "0")  # the list is made while loading: by tasks, however few folders there are
    try:
        found = reader.load(folders or root)
    finally:
        spark.conf.set(LISTING, before)
    text = F.col("content").cast("string")
    return found.select(
        F.substring_index(tail, "/", 1).alias("version_id"),
        F.substring_index(rest, "/", 1).alias("module"),
        F.regexp_replace(rest, "^[^/]*/", "").alias("relative_path"),
        F.when(F.is_valid_utf8(text), text).alias("content"),
        F.when(~F.is_valid_utf8(text), F.col("content")).alias("raw"),
        F.sha2(F.col("content"), 256).alias("content_sha"),
    )


def with_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """File rows with their number of lines, the text itself dropped.

    Bytes that are no UTF-8 are skipped when lines are counted.
    """
    text = F.col(content)
    if "raw" in files.columns:
        text = F.coalesce(text, F.replace(F.make_valid_utf8(F.col("raw").cast("string")), F.lit("�"), F.lit("")))
    return files.withColumn("lines", line_count(text)).drop(content, "raw")
