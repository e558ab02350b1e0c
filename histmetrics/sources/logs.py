"""Commit logs: six-field records, version lists and short logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histmetrics.functions.validate import valid_email, valid_epoch, valid_hash
from histmetrics.functions.values import epoch_ts
from histmetrics.operators.ordering import global_position

FIELD_MARK = "\x1f"
# White space at the ends of a record; the field mark itself counts as such.
_ENDS = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def parse_commit_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed fields of each record, or the reason why it has none.

    Reasons: ``empty_output``, ``wrong_field_count``, ``invalid_hash``,
    ``invalid_epoch``, ``invalid_email``.
    """
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), _ENDS, "")
    parts = F.split(text, FIELD_MARK)
    authored, committed = valid_epoch(F.get(parts, F.lit(3))), valid_epoch(F.get(parts, F.lit(4)))
    reason = (
        F.when(F.length(text) == 0, "empty_output")
        .when(F.size(parts) != 6, "wrong_field_count")
        .when(valid_hash(F.get(parts, F.lit(0))).isNull(), "invalid_hash")
        .when(authored.isNull() | committed.isNull(), "invalid_epoch")
        .when(valid_email(F.get(parts, F.lit(2))).isNull(), "invalid_email")
    )

    def good(c: Column) -> Column:
        return F.when(F.col("failure_reason").isNull(), c)

    return lines.withColumn("failure_reason", reason).select(
        *lines.columns,
        good(F.get(parts, F.lit(0))).alias("version_id"),
        good(F.get(parts, F.lit(1))).alias("author_name"),
        good(F.get(parts, F.lit(2))).alias("author_email"),
        good(epoch_ts(authored)).alias("authored_at"),
        good(epoch_ts(committed)).alias("committed_at"),
        good(F.get(parts, F.lit(5))).alias("summary"),
        "failure_reason",
    )


def plan_versions(commits: DataFrame, seq: str = "seq") -> DataFrame:
    """Versions to analyse: blank ids and merges out, oldest first, 0-based order.

    ``commits`` holds ``(version_id, parents ARRAY, seq)``; ``seq`` numbers the
    log lines from the oldest.
    """
    kept = commits.where((F.trim("version_id") != "") & (F.size("parents") < 2)).select(
        F.trim("version_id").alias("version_id"), seq
    )
    return global_position(kept, [seq, "version_id"], name="version_order").drop(seq)


def plan_short_log(lines: DataFrame, limit: int = 100, column: str = "value", seq: str = "seq") -> DataFrame:
    """The first ``limit`` lines ``<hash> <epoch> <subject>`` up to a blank one; order = position.

    Lines are numbered by ``seq``, which may have gaps; blank lines before the
    first record do not count.
    """
    blank = F.trim(column) == ""
    first = lines.where(~blank).agg(F.min(seq)).scalar()
    here = lines.where(F.col(seq) >= first)
    stop = here.where(blank).agg(F.min(seq)).scalar()
    records = here.where(F.coalesce(F.col(seq) < stop, F.lit(True))).select(
        F.split(F.ltrim(column), " ", 2)[0].alias("version_id"), seq
    )
    placed = global_position(records, [seq], name="_place")
    return placed.where(F.col("_place") < limit).select("version_id", F.col("_place").cast("int").alias("version_order"))


def pending_versions(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Planned versions that the store does not hold; their order is kept."""
    return planned.join(stored.select("version_id"), "version_id", "left_anti")
