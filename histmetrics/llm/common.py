"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from histmetrics.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read again, so that its size is known to the planner."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def annotate(
    df: DataFrame,
    column: str,
    fn: Callable[[list[bytes | None]], Sequence[Sequence]],
    fields: list[T.StructField],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (a struct of the kept columns) beside what ``fn`` computes from one text column.

    The kept columns travel as one struct, so no name of theirs can clash with a
    computed one and repeated or null ids need no join back. ``fn`` gets whole
    texts as bytes (None for null), one Arrow batch at a time.
    """
    names = list(keep if keep is not None else df.columns)
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in names]).alias("row")
    # A text that is kept anyway is read from the struct and not sent twice.
    inside = column in names and df.schema[column].dataType == T.StringType()
    packed = df.select(row) if inside else df.select(row, F.col(column).cast("binary").alias("body"))
    schema = T.StructType([packed.schema["row"], *fields])
    outputs, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(0).field(column).cast(pa.binary()) if inside else batch.column(1)
                made = [pa.array(v, type=t) for v, t in zip(fn(texts.to_pylist()), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["row", *outputs])

    return packed.mapInArrow(run, schema)


def fold(column: Column | str, folds: int) -> Column:
    """crc32 of an id's text, modulo ``folds`` (a null id counts as an empty text)."""
    text = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def labelled(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int
) -> DataFrame:
    """At most ``limit`` documents of each class with a known label outside the held-out fold.

    The sample is the rows with the smallest hash of their id, so reruns agree.
    It is the only thing broadcast, and ``limit`` bounds it.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("_most"))
        .where((F.col("y") == F.col("_most")) & (fold("doc_id", folds) != held_out))
        .select("doc_id", "y")
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def dual_svm(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, cost: np.ndarray, epochs: int = 12, seed: int = 7
) -> np.ndarray:
    """Linear hinge-loss model by dual coordinate descent over sparse rows (indices, values).

    One dual variable per row is moved to its optimum in turn, between 0 and the
    row's cost; the weights are kept equal to the sum of the duals' rows.
    """
    w, alpha = np.zeros(width), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            if square[i] == 0:
                continue
            step = alpha[i] - (y[i] * float(w[idx] @ val) - 1.0) / square[i]
            step = min(max(step, 0.0), cost[i])
            change = step - alpha[i]
            if change:
                w[idx] += change * y[i] * val
                alpha[i] = step
                moved = max(moved, abs(change) * math.sqrt(square[i]))
        if moved < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps; y is 0 or 1."""
    a, b = 1.0, 0.0
    ones, zeros = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - goal) * margin).sum() + ridge * a, (p - goal).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + ridge, (v * margin).sum()], [(v * margin).sum(), v.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
