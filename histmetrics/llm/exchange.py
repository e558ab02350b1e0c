"""Batches of documents and buckets of hashes that exchange packed arrays.

A corpus has far more shingles or substrings than a job should have rows. So
documents are dealt into batches by a hash, a batch packs what it has to say to
a bucket of hash values into one row, the bucket answers the batch in one row,
and arrays inside a row are handled by numpy. A batch says each hash once, so a
hash that a third of all documents hold reaches its bucket once per batch.

``parts`` gives the number of batches, and of buckets: the square root of the
corpus over ``MESSAGE`` bytes, so that a message keeps its size, and the number
of messages stays in proportion to the corpus, at every size.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histmetrics.session import scratch_path

MESSAGE = 2048

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def parts(documents: DataFrame, text: str = "text") -> int:
    total = documents.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(math.sqrt(total / MESSAGE)))


def batch_of(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def pack_sorted(hashes: np.ndarray, count: int) -> bytes:
    """Rising hashes of one bucket as differences of 40 bits, byte by byte, so that high bytes compress well."""
    inside = hashes * np.uint64(count) >> np.uint64(24)
    steps = np.diff(inside, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    """The 40 bits that tell hashes of one bucket apart."""
    steps = np.zeros((len(packed) // 5, 8), dtype=np.uint8)
    steps[:, :5] = np.frombuffer(packed, dtype=np.uint8).reshape(5, -1).T
    return np.cumsum(steps.view("<u8").ravel())


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers; different integers stay different."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bucket_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """Bucket of each hash by its high bits; sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


class Powers:
    """Powers of an odd number modulo 2**64 and their inverses, so that a prefix sum gives every substring's hash."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers()


def prefix_sums(body: np.ndarray) -> np.ndarray:
    """Running sums of bytes times powers; ``sums[e] - sums[s]`` times the inverse power of s is a substring's hash."""
    up, _ = POWERS.upto(len(body) + 1)
    sums = np.zeros(len(body) + 1, dtype=np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=sums[1:])
    return sums


def key_of(body: bytes) -> bytes | None:
    return hashlib.blake2b(body, digest_size=16).digest() if body else None


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


@contextmanager
def classes(documents: DataFrame, count: int, normal: Callable[[bytes | None], bytes]) -> Iterator[DataFrame]:
    """batch, key, first_id, n, body of texts that are not empty; copies inside an Arrow batch are one row already.

    Bodies are compressed one by one. The rows are written to the shared folder as
    a table bucketed by batch, so that texts cross the network once: steps that
    group by batch read them where they lie. The table's name goes with the context.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = normal(text)
                key = key_of(body)
                if key is not None:
                    row = found.get(key) or found.setdefault(key, [None, 0, press(body)])
                    row[0], row[1] = _least(row[0], doc_id), row[1] + 1
            columns = list(zip(*found.values())) or [(), (), ()]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, type=pa.binary()), *(pa.array(c, type=t) for c, t in zip(columns, kinds))],
                ["key", "first_id", "n", "body"],
            )

    made = documents.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(
        run, f"key binary, first_id {kind}, n long, body binary"
    )
    batched = made.select(batch_of(F.col("key"), count).alias("batch"), "key", "first_id", "n", "body")
    spark = documents.sparkSession
    partitions, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"classes_{uuid.uuid4().hex}"
    writer = batched.repartition(partitions, "batch").write.format("parquet").bucketBy(partitions, "batch")
    writer.option("path", scratch_path(spark, "classes")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def members(table: pa.Table) -> tuple[list[bytes], list, list[int], list[bytes]]:
    """Keys, first ids, numbers of documents and bodies of a batch's classes, by key."""
    found: dict[bytes, list] = {}
    for key, first, n, body in zip(*(table[c].to_pylist() for c in ("key", "first_id", "n", "body"))):
        row = found.setdefault(key, [None, 0, body])
        row[0], row[1] = _least(row[0], first), row[1] + n
    keys, unpress = sorted(found), zstandard.ZstdDecompressor().decompress
    return keys, *([found[k][i] for k in keys] for i in range(2)), [unpress(found[k][2]) for k in keys]
