"""Result output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV has none."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )


def write_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write as ``json``, ``csv`` (with header), ``parquet`` or ``text`` (all rows, a tab between columns)."""
    if fmt == "csv":
        flat_for_csv(df).write.mode(mode).option("header", "true").csv(path)
    elif fmt == "text":
        flat = flat_for_csv(df)
        flat.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in flat.columns])).write.mode(mode).text(path)
    elif fmt in ("json", "parquet"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"unknown format: {fmt}")

