"""Small made-up corpora for the tests of the training-data operators."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SYLLABLES = "ka lo mi ten ra vos pel dun sha ri go be nor ta ulm éa ßi".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n):
    out = words(rng, n)
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


def frame(spark, rows, extra=False):
    """documents of (doc_id, text, source); extra adds columns whose names the operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for name in ("row", "key", "score", "kept", "size", "target", "batch", "body", "rank", "label"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def odd_rows():
    """Null, empty, blank, short, repeated and long texts; null ids and sources."""
    long = prose(random.Random(5), 30_000)
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\n", None),
        (4, "one", "b"),
        (5, long, "b"),
        (5, long, "b"),
        (None, "some text without an id that is long enough to hold fifty bytes", None),
        (6, "tie tie tie", "c"),
        (7, "tie tie tie", "c"),
        (8, "\U0001f600 ünï çode", ""),
    ]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
