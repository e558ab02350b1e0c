"""Positions, neighbours, duplicates and scaling.

These are window functions over a whole table or over groups without a size
bound, so none of them is written as one window: positions come from per-bucket
counts, winners and extremes from aggregates that are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histmetrics.session import cut_lineage


def global_position(
    df: DataFrame, order: Sequence[Column | str], bucket: Column | None = None, name: str = "position"
) -> DataFrame:
    """0-based position of each row in a total order, without sorting in one task.

    Rows are dealt into ranges whose bounds Spark samples from the data, so they are even
    however the keys lie. Rows are ranked inside their range; the ranges' counts, one row
    each, give the offsets. A caller that has a ``bucket`` which never falls along ``order``
    (and is even) saves the dealing.
    """
    if bucket is None:
        # Written before it is read twice, so that both readers see the same ranges.
        tagged = cut_lineage(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()))
    else:
        tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        tagged.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, "_bucket")
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_offset")
    )


def version_neighbors(versions: DataFrame, order: str = "version_order") -> DataFrame:
    """Position, previous and next version, and whether the sequence ends here."""
    placed = cut_lineage(global_position(versions.select("version_id", order), [order]))
    earlier = placed.select((F.col("position") + 1).alias("position"), F.col("version_id").alias("previous_id"))
    later = placed.select((F.col("position") - 1).alias("position"), F.col("version_id").alias("next_id"))
    return (
        placed.join(earlier, "position", "left")
        .join(later, "position", "left")
        .select(
            "version_id",
            order,
            "position",
            "previous_id",
            "next_id",
            F.col("next_id").isNull().alias("at_end"),
        )
    )


def _duplicate_winners(candidates: DataFrame, keys: list[str], prefix: str | None) -> DataFrame:
    first = F.min_by("path", "seq")
    if prefix is None:
        return candidates.groupBy(*keys).agg(
            first.alias("first_path"),
            F.lit(None).cast("string").alias("preferred_path"),
            F.lit(None).cast("long").alias("preferred_seq"),
            F.min("seq").alias("first_seq"),
            F.count(F.lit(1)).alias("candidates"),
        )
    seq = F.when(F.col("path").startswith(prefix), F.col("seq"))
    return candidates.groupBy(*keys).agg(
        first.alias("first_path"),
        F.min_by(F.when(seq.isNotNull(), F.col("path")), seq).alias("preferred_path"),
        F.min(seq).cast("long").alias("preferred_seq"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("candidates"),
    )


def resolve_duplicates(
    candidates: DataFrame,
    policy: str = "keep_first",
    prefix: str | None = None,
    keys: Sequence[str] = ("version_id", "module"),
) -> tuple[DataFrame, DataFrame]:
    """One candidate per name, and a warning row per candidate passed over.

    ``candidates`` holds ``(…keys, path, seq)``; ``policy`` is ``keep_first``,
    ``prefer_prefix`` (needs ``prefix``) or ``fail``. A warning names the path
    kept at that moment, so rows before the first preferred one name the first.
    """
    keys = list(keys)
    winners = _duplicate_winners(candidates, keys, prefix if policy == "prefer_prefix" else None)
    if policy == "fail":
        told = F.concat(F.lit("Duplicate module name "), F.col(keys[-1]), F.lit(": "), F.col("first_path"))
        winners = winners.withColumn(
            "first_path",
            F.when(F.col("candidates") > 1, F.raise_error(told).cast("string")).otherwise(F.col("first_path")),
        )
    chosen = F.coalesce("preferred_path", "first_path")
    kept = winners.select(*keys, chosen.alias("path"), F.coalesce("preferred_seq", "first_seq").alias("seq"))

    at_first = F.col("seq") == F.col("first_seq")
    before_preferred = F.col("seq") < F.col("preferred_seq")
    kept_then = (
        F.when(F.col("preferred_path").isNull(), F.col("first_path"))
        .when(~at_first & before_preferred, F.col("first_path"))
        .otherwise(F.col("preferred_path"))
    )
    warnings = (
        candidates.join(winners, keys)
        .where(F.col("seq") != F.coalesce("preferred_seq", "first_seq"))
        .select(*keys, kept_then.alias("kept_path"), F.col("path").alias("skipped_path"))
    )
    return kept, warnings


def minmax_scale(
    df: DataFrame, value: str, keys: Sequence[str] = ("version_id",), equal: float = 0.5, name: str = "scaled"
) -> DataFrame:
    """Value scaled to [0, 1] over its group; NULL is 0, all-equal groups get ``equal``."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    v, low, high = F.col(value), F.col("_low"), F.col("_high")
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    scaled = F.when(v.isNull(), F.lit(0.0)).when(high <= low, F.lit(equal)).otherwise(inside)
    return df.join(ends, list(keys), "left").withColumn(name, scaled).drop("_low", "_high")
