"""Analysis batches as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics import schemas
from histmetrics.session import stored

PARTS = {
    "files": "file_metric",
    "modules": "module_aggregate",
    "edges": "coupling_edge",
    "failures": "failure",
}
LINE_ROWS = 1000
#: What a line holds the rows of, beside its version and part.
OWNER = {"files": "module", "modules": "module", "edges": "source", "failures": "file_path"}


def batch_lines(versions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """A row per version, part and module (source of edges, file of failures) in the nested batch shape.

    Lines of a version repeat its commit; a version without rows has one line. Owners with
    more than ``LINE_ROWS`` rows are split by a hash of the row, so no line grows with the
    size of a version or of a module.
    """
    parts = []
    for part, table in PARTS.items():
        if part not in tables:
            continue
        columns = [f.name for f in schemas.TABLES[table].fields if f.name != "version_id"]
        row = F.struct(*columns)
        parts.append(
            tables[part].select(
                "version_id",
                F.lit(part).alias("_part"),
                F.col(OWNER[part]).alias("_owner"),
                *[(row if p == part else F.lit(None)).alias(p) for p in PARTS if p in tables],
            )
        )
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    owner = ["version_id", "_part", "_owner"]
    counts = rows.groupBy(*owner).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LINE_ROWS)
    large = stored(counts.select(*[F.col(c).alias(f"{c}_") for c in owner], F.ceil(F.col("_n") / LINE_ROWS).alias("_lines")), "large-owners")
    same = [rows[c].eqNullSafe(large[f"{c}_"]) for c in owner]
    whole = F.xxhash64(*[F.to_json(p) for p in PARTS if p in tables])
    line = F.when(F.col("_lines").isNotNull(), F.pmod(whole, F.col("_lines"))).otherwise(0)
    rows = rows.join(large, same, "left").withColumn("_line", line)
    gathered = rows.groupBy(*owner, "_line").agg(*[F.collect_list(p).alias(p) for p in PARTS if p in tables])
    commit = versions.select("version_id", F.struct(*[f.name for f in schemas.VERSION.fields]).alias("commit"))
    return commit.join(gathered, "version_id", "left").select("commit", *[p for p in PARTS if p in tables])


def write_batches_jsonl(versions: DataFrame, tables: dict[str, DataFrame], path: str) -> None:
    batch_lines(versions, tables).write.mode("errorifexists").json(path)


def read_batches_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Batches as written; a line that is no batch keeps its text in ``_corrupt_record``."""
    schema = T.StructType([*schemas.BATCH.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def explode_batches(batches: DataFrame) -> dict[str, DataFrame]:
    """The four row tables and the versions; unreadable lines become failures."""

    def usable(c: Column) -> Column:
        return F.col("commit.version_id").isNotNull() & c.isNotNull()

    out = {
        "version": batches.where(F.col("commit.version_id").isNotNull()).select("commit.*").distinct()
    }
    for part, table in PARTS.items():
        row = F.explode(part).alias("row")
        rows = batches.where(usable(F.col(part))).select(F.col("commit.version_id").alias("version_id"), row)
        fields = [f.name for f in schemas.TABLES[table].fields if f.name != "version_id"]
        out[table] = rows.select("version_id", *[F.col(f"row.{f}") for f in fields])
    bad = batches.where(F.col("commit.version_id").isNull()).select(
        F.lit(None).cast("string").alias("version_id"),
        F.lit(None).cast("string").alias("run_id"),
        F.lit(None).cast("string").alias("file_path"),
        F.concat(F.lit("unreadable batch: "), F.coalesce("_corrupt_record", F.lit(""))).alias("error_text"),
    )
    out["failure"] = out["failure"].unionByName(bad)
    return out
