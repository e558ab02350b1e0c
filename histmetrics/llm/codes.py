"""Vector code compression: active-entry Lloyd over integer parts.

Components become integers, vectors are cut into ``PARTS`` equal parts, and each
part position gets a codebook of ``ENTRIES`` entries by Lloyd rounds in exact
integer arithmetic. The active-entry rule saves most of a round: every part keeps
its entry and the exact distance to it. If that entry did not move in the last
update, no other entry that stayed can beat it now, so only the entries that moved
are compared with the stored distance; parts whose own entry moved are compared
with all entries. Ties go to the lower index in both cases.

A round is one job. Its tasks read the packed state of the round before (integers,
entries, distances), and write the new state and, per task, the sums and counts of
each entry's parts; the sums are added up by Spark, and only ``PARTS`` x ``ENTRIES``
of them, a number that no input changes, come to the driver and go out with the next
job. The state is a table in the shared folder, so a lost executor costs a re-read;
the state before is removed once the next one is there.

Defined results: vectors that are null or empty, or hold null or non-finite components,
are dropped. Rows with a null vec_id are coded but begin no codebook (where no id is known,
there are no codes and the result is empty); repeated rows are
vectors of their own; fewer than ``ENTRIES`` vectors make shorter codebooks; equal
labels include null ones; an empty table gives an empty result. All vectors must be
of one length that ``PARTS`` divides, and components below 2**17 in size (2**27
after scaling): anything else is refused with an error, because it has no code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histmetrics.llm.common import written
from histmetrics.session import remove_folder, scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 2**27
#: Float64 products are exact while every partial sum stays below 2**53.
EXACT = 2**53


def usable(vectors: pa.ListArray) -> np.ndarray:
    """Which vectors are there, not empty, and hold finite components only."""
    good = np.array(vectors.is_valid().to_pylist(), dtype=bool)
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(np.float64))
    if flat.null_count:
        bad |= np.array(flat.is_null().to_pylist(), dtype=bool)
    upto = np.concatenate([[0], np.cumsum(bad)])
    return good & (upto[offsets[1:]] == upto[offsets[:-1]]) & (offsets[1:] > offsets[:-1])


def scaled(vectors: pa.ListArray, good: np.ndarray, scale: int, largest: int = LARGEST) -> np.ndarray:
    """floor(scale * x) of the usable vectors, one row each; all must be of one length."""
    chosen = vectors.filter(pa.array(good))
    lengths = np.diff(chosen.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(set(lengths.tolist()))[:5]}")
    flat = chosen.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    made = np.floor(scale * flat)
    if len(made) and np.abs(made).max() >= largest:
        raise ValueError(f"a component of {np.abs(made).max() / scale:g} is too large")
    return made.astype(np.int64).reshape(len(lengths), -1)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, as integers."""
    width = x.shape[1]
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 4 * width * largest * largest < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    if 4 * width * largest * largest < 2**63:
        return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    raise ValueError("components are too large for distances of 64 bits")


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of each row's nearest entry; the lowest index of equal ones."""
    found = distances(x, entries)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(x)), best]


def reassign(
    x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, stored: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest` by the active-entry rule, from the entry and exact distance of the round before."""
    code, stored = code.copy(), stored.copy()
    again = moved[code]
    if again.any():
        code[again], stored[again] = nearest(x[again], entries)
    active = np.flatnonzero(moved)
    kept = np.flatnonzero(~again)
    if len(active) and len(kept):
        best, near = nearest(x[kept], entries[active])
        best = active[best]
        better = (near < stored[kept]) | ((near == stored[kept]) & (best < code[kept]))
        at = kept[better]
        code[at], stored[at] = best[better], near[better]
    return code, stored


@dataclass
class Books:
    """Codebooks of all parts (PARTS, entries, width) and which entries the last update moved."""

    entries: np.ndarray
    moved: np.ndarray | None = None

    def assign(self, x: np.ndarray, codes: np.ndarray | None, stored: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        width = self.entries.shape[2]
        if x.shape[1] != PARTS * width:
            raise ValueError(f"a vector of length {x.shape[1]} among those of {PARTS * width}")
        out = []
        for p in range(PARTS):
            part = x[:, p * width : (p + 1) * width]
            if codes is None:
                out.append(nearest(part, self.entries[p]))
            else:
                out.append(reassign(part, self.entries[p], self.moved[p], codes[:, p].astype(np.int64), stored[:, p]))
        return np.stack([c for c, _ in out], axis=1), np.stack([d for _, d in out], axis=1)

    def updated(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Books:
        """Every used entry becomes the floor of its parts' mean."""
        entries = self.entries.copy()
        for (p, e), (n, total) in sums.items():
            entries[p, e] = [s // n for s in total]
        return Books(entries, (entries != self.entries).any(axis=2))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for v in self.entries.ravel().tolist()).encode()).hexdigest()


class Sums:
    """Sums and counts of the parts of each entry, over all batches of a task."""

    def __init__(self, books: Books):
        parts, entries, width = books.entries.shape
        self.total = np.zeros((parts, entries, width), dtype=np.int64)
        self.count = np.zeros((parts, entries), dtype=np.int64)

    def add(self, x: np.ndarray, codes: np.ndarray) -> None:
        width = self.total.shape[2]
        for p in range(PARTS):
            order = np.argsort(codes[:, p], kind="stable")
            used, first, n = np.unique(codes[order, p], return_index=True, return_counts=True)
            self.total[p, used] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
            self.count[p, used] += n

    def rows(self) -> tuple[list[int], list[int], list[int], list[list[int]]]:
        p, e = np.nonzero(self.count)
        return p.tolist(), e.tolist(), self.count[p, e].tolist(), self.total[p, e].tolist()


STATE = ("vec_id", "label", "ints", "codes", "stored")
NAMES = (*STATE, "part", "entry", "n", "total", "kind")
_INTS, _CODES = "<i4", "<u1"


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def whole(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind).reshape(batch.num_rows, -1)

    return whole("ints", _INTS).astype(np.int64), whole("codes", _CODES), whole("stored", "<i8")


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    made = np.ascontiguousarray(x, dtype=kind)
    return pa.array([row.tobytes() for row in made], type=pa.binary())


def assign_round(rows: DataFrame, books: Books, first: bool) -> str:
    """Write the new state (kind 0) and the sums of each task (kind 1); the folder's name comes back.

    ``rows`` holds vectors in the first round and the state before it later.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ids = Sums(books), None
        for batch in batches:
            if first:
                good = usable(batch.column("embedding"))
                x, codes, stored = scaled(batch.column("embedding"), good, SCALE), None, None
                batch = batch.filter(pa.array(good))
            else:
                x, codes, stored = _unpack(batch)
            ids = [batch.schema.field(c).type for c in ("vec_id", "label")]
            if not batch.num_rows:
                continue
            codes, stored = books.assign(x, codes, stored)
            sums.add(x, codes)
            state = [batch.column("vec_id"), batch.column("label"), _packed(x, _INTS), _packed(codes, _CODES), _packed(stored, "<i8")]
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*state, *none, pa.array([0] * batch.num_rows, type=pa.int32())], list(NAMES))
        part, entry, n, total = sums.rows()
        if n:
            none = [pa.nulls(len(n), t) for t in (*ids, pa.binary(), pa.binary(), pa.binary())]
            made = [pa.array(part, type=pa.int32()), pa.array(entry, type=pa.int32()), pa.array(n, type=pa.int64()),
                    pa.array(total, type=pa.list_(pa.int64())), pa.array([1] * len(n), type=pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, *made], list(NAMES))

    out = rows.mapInArrow(
        run,
        f"vec_id {kinds[0]}, label {kinds[1]}, ints binary, codes binary, stored binary, "
        "part int, entry int, n long, total array<long>, kind int",
    )
    path = scratch_path(rows.sparkSession, "codes")
    out.write.parquet(path)
    return path


def state_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    kinds = [like.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    schema = f"vec_id {kinds[0]}, label {kinds[1]}, ints binary, codes binary, stored binary, kind int"
    return spark.read.schema(schema).parquet(path).where("kind = 0").drop("kind")


def sums_of(spark: SparkSession, path: str, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, sums) of each used entry: at most PARTS x ENTRIES rows."""
    rows = spark.read.schema("part int, entry int, n long, total array<long>, kind int").parquet(path).where("kind = 1")
    added = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    found = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()
    return {(r["part"], r["entry"]): (r["n"], [int(r[f"s{k}"]) for k in range(width)]) for r in found}


def clean(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.select("vec_id", "label", "embedding").where((F.size("embedding") > 0) & finite)


def starting_books(embeddings: DataFrame) -> Books | None:
    """The integer parts of the ENTRIES vectors with the smallest ids; equal ids are ordered by their vectors.

    The bound of the ids is found on ids alone. No more than ENTRIES vectors reach
    the driver, as one row that an aggregate has made.
    """
    known = clean(embeddings).where(F.col("vec_id").isNotNull())
    last = known.select("vec_id").orderBy("vec_id").limit(ENTRIES).agg(F.max("vec_id").alias("v")).first()["v"]
    if last is None:
        return None
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("ints")
    least = known.where(F.col("vec_id") <= F.lit(last)).select("vec_id", ints).orderBy("vec_id", "ints").limit(ENTRIES)
    rows = least.agg(F.sort_array(F.collect_list(F.struct("vec_id", "ints"))).alias("rows")).first()["rows"]
    if len({len(r["ints"]) for r in rows}) > 1 or not rows[0]["ints"] or len(rows[0]["ints"]) % PARTS:
        raise ValueError(f"vectors must be of one length that {PARTS} divides")
    x = np.array([r["ints"] for r in rows], dtype=np.int64)
    return Books(np.ascontiguousarray(x.reshape(len(rows), PARTS, -1).transpose(1, 0, 2)))


def compress(embeddings: DataFrame) -> tuple[DataFrame, Books | None]:
    """vec_id, label, code, error of every kept vector, and the codebooks."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", "embedding")
    books, path = starting_books(rows), None
    if books is None:
        # Without a known id there is no codebook and no code.
        none = rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none, None
    for number in range(ROUNDS + 1):
        before, path = path, assign_round(rows if path is None else state_of(spark, path, embeddings), books, path is None)
        if before is not None:
            remove_folder(spark, before)
        if number < ROUNDS:
            books = books.updated(sums_of(spark, path, books.entries.shape[2]))
    final = state_of(spark, path, embeddings)
    code = F.lower(F.hex("codes"))
    return final.select("vec_id", "label", code.alias("code"), _total("stored").alias("error")), books


def _total(packed: str) -> Column:
    """Sum of PARTS little-endian integers of 8 bytes."""
    digits = F.hex(packed)

    def one(p: int):
        turned = F.concat(*[F.substring(digits, 16 * p + 2 * b + 1, 2) for b in range(7, -1, -1)])
        return F.conv(turned, 16, 10).cast("long")

    total = one(0)
    for p in range(1, PARTS):
        total = total + one(p)
    return total


def compress_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    coded, books = compress(embeddings)
    # One row per label in a written table: the planner broadcasts it only if it is small.
    by_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    by_label = by_label.withColumnRenamed("label", "_label")
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"]))
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256")
    )


def sql(rounds: int = ROUNDS) -> str:
    """The rounds written out, each with every part against every entry."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
             row_number() OVER () AS r FROM embeddings
             WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT r, vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x
             FROM kept, range({PARTS}) t(p))""",
        f"""firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL
             ORDER BY vec_id, v LIMIT {ENTRIES})""",
        "books0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN firsts USING (r))",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (
              SELECT r, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
              FROM parts JOIN books{k} USING (p)) GROUP BY r, p)"""
        )
        if k < rounds:
            steps.append(
                f"""means{k} AS (SELECT p, best.e AS e, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS c FROM (
                  SELECT p, best, i, (s - ((s % n) + n) % n) // n AS floor_sum FROM (
                  SELECT p, struct_pack(e := best.e) AS best, i, sum(x[i]) AS s, count(*) AS n
                  FROM parts JOIN near{k} USING (r, p), range(1, len(x) + 1) t(i) GROUP BY ALL)) GROUP BY p, best.e)"""
            )
            steps.append(
                f"""books{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN means{k} m USING (p, e))"""
            )
    last = rounds
    return f"""WITH {", ".join(steps)},
      coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{last} GROUP BY r)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM books{last}) AS codebooks_sha256
      FROM kept JOIN coded USING (r)"""


SQL = sql()
