"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from histmetrics.session import cut_lineage

#: Links in a file of a round's checkpoint, about: few links make one file, however many partitions they come from.
FILE_LINKS = 1 << 18


def settled(links: DataFrame) -> tuple[DataFrame, Row]:
    """A round's links, checkpointed in as many files as their number asks for, with that number and a sum of their hashes.

    A file system without native code starts a process for each file that an executor makes.
    """
    held = links.persist()
    now = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    edges = cut_lineage(held.coalesce(max(1, math.ceil(now["n"] / FILE_LINKS))))
    held.unpersist()
    return edges, now


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of ``links`` (a, b).

    Large and small stars alternate: every node's larger, then smaller neighbours
    are linked to its smallest one, until nothing changes. Minima are aggregates
    that are joined back, so a node with many links is no group of its own; each
    round is checkpointed, and only two sums come to the driver.
    """
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges, _ = settled(links.where(F.col("a") != F.col("b")).select(larger, smaller).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        edges, now = settled(small.distinct())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
