"""Filtered views of the graph: visible weight, neighbourhoods, counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmetrics.session import stored


def visible_edges(
    edges: DataFrame, groups: Sequence[str], minimum: int = 1, include_zero: bool = False
) -> DataFrame:
    """Edges by the points of the enabled groups; those below the minimum are hidden."""
    shown = F.map_filter("breakdown", lambda k, _: k.isin(*groups)) if groups else F.map_filter(
        "breakdown", lambda k, _: F.lit(False)
    )
    weight = F.aggregate(F.map_values(shown), F.lit(0).cast("long"), lambda acc, v: acc + v)
    floor = minimum if include_zero else max(minimum, 1)
    out = edges.withColumn("visible_weight", weight).where(F.col("visible_weight") >= floor)
    return out if groups else out.where(F.lit(False))


def neighborhood(
    edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "both", laid_out: bool = False
) -> DataFrame:
    """Nodes within ``depth`` hops of the seeds, with the hop they are first met at.

    ``seeds`` holds ``(version_id, node)``; ``direction`` is ``out``, ``in`` or
    ``both``. Edges and frontiers are stored tables (``laid_out``: the edges are one
    already): a small frontier is broadcast to the edges, once for each direction, and no
    edge is shuffled for it. What a hop meets is held against earlier frontiers, in both
    directions against the last two alone, where all known neighbours of a frontier must
    be. The walk ends when a hop meets nothing new.
    """
    if depth < 1:
        raise ValueError(f"depth must be at least 1, got {depth}")
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be out, in or both, got {direction!r}")
    if not laid_out:
        edges = stored(edges.select("version_id", "source", "target"), "edges")
    forward = edges.select("version_id", F.col("source").alias("node"), F.col("target").alias("next"))
    backward = edges.select("version_id", F.col("target").alias("node"), F.col("source").alias("next"))
    ways = {"out": [forward], "in": [backward], "both": [forward, backward]}[direction]

    frontiers = [stored(seeds.select("version_id", "node").distinct(), "frontier")]
    while len(frontiers) <= depth:
        steps = [frontiers[-1].join(way, ["version_id", "node"]).select("version_id", F.col("next").alias("node")) for way in ways]
        met = reduce(DataFrame.unionByName, steps).distinct()
        for known in frontiers[-2:] if direction == "both" else frontiers:
            met = met.join(known, ["version_id", "node"], "left_anti")
        met = stored(met, "frontier")
        if met.isEmpty():
            break
        frontiers.append(met)
    hops = [f.withColumn("hop", F.lit(hop)) for hop, f in enumerate(frontiers)]
    return reduce(DataFrame.unionByName, hops)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    near = nodes.select("version_id", "node").distinct()
    return edges.join(near.withColumnRenamed("node", "source"), ["version_id", "source"], "left_semi").join(
        near.withColumnRenamed("node", "target"), ["version_id", "target"], "left_semi"
    )


def graph_stats(
    nodes: DataFrame, edges: DataFrame, shown_nodes: DataFrame, shown_edges: DataFrame
) -> DataFrame:
    """Visible, total and hidden nodes and edges per version."""

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("version_id").agg(F.count(F.lit(1)).alias(name))

    out = tally(nodes, "total_nodes")
    for df, name in ((edges, "total_edges"), (shown_nodes, "visible_nodes"), (shown_edges, "visible_edges")):
        out = out.join(tally(df, name), "version_id", "left")
    out = out.na.fill(0)
    return out.withColumn("hidden_nodes", F.col("total_nodes") - F.col("visible_nodes")).withColumn(
        "hidden_edges", F.col("total_edges") - F.col("visible_edges")
    )
