"""Reading stored tables and checking that they fit the expected schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics import schemas


class MissingTable(LookupError):
    """The store has no such table."""


class IncompatibleSchema(ValueError):
    """The stored schema cannot be read as the expected one."""


def read_table(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """One history table; columns added since it was written read as NULL."""
    expected = schema or schemas.TABLES.get(table)
    if expected is None:
        raise MissingTable(f"unknown table: {table}")
    try:
        return spark.read.schema(expected).parquet(f"{root.rstrip('/')}/{table}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise MissingTable(f"no table {table} under {root}") from error
        raise


def table_exists(spark: SparkSession, root: str, table: str) -> bool:
    try:
        read_table(spark, root, table)
    except MissingTable:
        return False
    return True


def _shape(kind: T.DataType) -> str:
    return kind.simpleString()


def schema_differences(actual: T.StructType, expected: T.StructType) -> list[str]:
    """Missing and differently typed columns, in words; additional ones are fine."""
    have = {f.name: _shape(f.dataType) for f in actual.fields}
    out = []
    for field in expected.fields:
        found = have.get(field.name)
        if found is None:
            out.append(f"missing {field.name}")
        elif found != _shape(field.dataType):
            out.append(f"{field.name} is {found}, expected {_shape(field.dataType)}")
    return out


def check_schema(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored table: expected and stored version, and what differs.

    Only file footers are read. Stored columns that later versions added may be
    missing; :func:`conform` fills them.
    """
    meta = read_table(spark, root, "meta").agg(F.max("schema_version").alias("stored_version"))
    rows = []
    for table, expected in schemas.TABLES.items():
        try:
            actual = spark.read.parquet(f"{root.rstrip('/')}/{table}").schema
        except AnalysisException:
            rows.append((table, False, "missing table"))
            continue
        rows.append((table, True, "; ".join(schema_differences(actual, expected))))
    found = spark.createDataFrame(rows, "table string, present boolean, differences string")
    out = found.withColumn("stored_version", meta.scalar()).withColumn(
        "expected_version", F.lit(schemas.SCHEMA_VERSION)
    )
    same = F.col("stored_version") == F.col("expected_version")
    return out.withColumn("compatible", same & F.col("present") & (F.col("differences") == ""))


def assert_compatible(stored_version: int | None) -> None:
    if stored_version != schemas.SCHEMA_VERSION:
        raise IncompatibleSchema(
            f"store has schema version {stored_version}, expected {schemas.SCHEMA_VERSION}; rebuild it"
        )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema, in order and type; absent ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
