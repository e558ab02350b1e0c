"""Hard-negative mining: Fagin's threshold algorithm over blocks of candidates.

Rows become integer vectors, and a score is an integer inner product. A block of
candidates keeps one list per dimension, sorted by that component. For an anchor,
each list is read from its best end, the high one where the anchor's component is
positive and the low one where it is negative; a row that is met for the first time
in any list is scored from its whole vector. No row that has not been met can score
more than the threshold, the anchor's product with the components that the lists
have come to. A search ends once the threshold lies strictly below the kth score of
every window (a tie could still win by its smaller id), or below the window itself.

Anchors are a stated query set against all rows. They go to the tasks in slabs of
about ``SLAB`` anchors, broadcast with that bound, and candidates stay where they are
read: per slab, a first job finds each anchor's positives among the rows of its
label, a second one its negatives inside the windows that the positives' scores set.
A task carries what it has found from block to block, so later searches end earlier,
and packs it into one row per ``TILE`` anchors at its end; tiles are merged as they
stream in. A row costs the same whatever its label, so no label or vector is hot.

Defined results: rows with a null vec_id or label, or a vector that is null, empty or
holds null or non-finite components take no part. Repeated rows, and rows of one id
that score the same against an anchor, count once; an anchor's other rows have
another id; different vectors under one anchor's id are anchors of their own. An
anchor without others of its label gives no row; an empty table gives an empty
result. All vectors must be of one length and components below 2**19 in size:
anything else is refused with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmetrics.llm.codes import EXACT, scaled, usable
from histmetrics.session import scratch_path

SCALE, EVERY, SHIFTED, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative scores at least LOW and at most HIGH hundredths of the positive's score.
LOW, HIGH = 50, 95
SLAB, TILE, FIRST_STEP = 16_384, 64, 16


def exact(x: np.ndarray) -> np.ndarray:
    """As float64 where all products are exact in it, else as integers."""
    largest = int(np.abs(x).max(initial=0))
    return x.astype(np.float64) if x.shape[1] * largest * largest < EXACT else x


class Lists:
    """A block's rows, and per dimension their order by component, lowest first."""

    def __init__(self, x: np.ndarray):
        self.x = exact(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.order, self.sorted = order.T.copy(), np.take_along_axis(x, order, axis=0).T.copy()

    def search(
        self, anchor: np.ndarray, take: Callable[[np.ndarray, np.ndarray], None], done: Callable[[int], bool]
    ) -> int:
        """Sorted access until ``done(threshold)``; ``take`` gets new rows and their scores. Returns the depth."""
        n = len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            up = np.array([0])  # all rows score zero, any list reaches them
        weights = anchor if self.x.dtype == np.int64 else anchor.astype(np.float64)
        met, depth, step = np.zeros(n, dtype=bool), 0, FIRST_STEP
        while depth < n:
            upto = min(n, depth + step)
            new = np.zeros(n, dtype=bool)
            new[self.order[up, n - upto : n - depth].ravel()] = True
            new[self.order[down, depth:upto].ravel()] = True
            new &= ~met
            met |= new
            rows = np.flatnonzero(new)
            if len(rows):
                take(rows, (self.x[rows] @ weights).astype(np.int64))
            depth, step = upto, step * 2
            threshold = int(anchor[up] @ self.sorted[up, n - depth]) + int(anchor[down] @ self.sorted[down, depth - 1])
            if done(threshold):
                break
        return depth


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by falling score, then rising id; what is equal in both counts once."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    same = np.zeros(len(ids), dtype=bool)
    same[1:] = (scores[1:] == scores[:-1]) & (ids[1:] == ids[:-1])
    return scores[~same][:k], ids[~same][:k]


@dataclass
class Top:
    """What a window holds so far; ``low`` and ``high`` bound the scores that it takes."""

    k: int
    low: int = -(2**62)
    high: int = 2**62
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.least()) & (scores <= self.high)
        if inside.any():
            merged = np.concatenate([self.scores, scores[inside]]), np.concatenate([self.ids, ids[inside]])
            self.scores, self.ids = best(*merged, self.k)

    def least(self) -> int:
        """A score below this one cannot enter any more."""
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def closed(self, threshold: int) -> bool:
        return threshold < self.least()


@dataclass
class Slab:
    """Anchors with their vectors, and what is known of their positives."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    positives: list[tuple[np.ndarray, np.ndarray]] | None = None

    def windows(self, a: int) -> list[Top]:
        """The positives' list in the first job, in the second a window for each positive."""
        if self.positives is None:
            return [Top(POSITIVES)]
        scores = self.positives[a][0].tolist()
        return [Top(NEGATIVES, -(-LOW * s // 100), HIGH * s // 100) for s in scores]


def _search(lists: Lists, ids: np.ndarray, fits: np.ndarray | None, anchor_id: int, anchor: np.ndarray, tops: list[Top]) -> None:
    """Fill an anchor's windows from a block; ``fits`` says which rows may enter (None: all)."""
    still = [t for t in tops if t.low <= t.high]
    if not still:
        return

    def take(rows: np.ndarray, scores: np.ndarray) -> None:
        least, most = min(t.least() for t in still), max(t.high for t in still)
        good = (scores >= least) & (scores <= most) & (ids[rows] != anchor_id)
        if fits is not None:
            good &= fits[rows]
        if good.any():
            for top in still:
                top.add(scores[good], ids[rows[good]])

    lists.search(anchor, take, lambda threshold: all(t.closed(threshold) for t in still))


def labelled_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and integer vectors of the rows that take part."""
    good = usable(batch.column("embedding"))
    good &= np.array(batch.column("vec_id").is_valid().to_pylist(), dtype=bool)
    good &= np.array(batch.column("label").is_valid().to_pylist(), dtype=bool)
    x = scaled(batch.column("embedding"), good, SCALE)
    ids, labels = (batch.column(c).filter(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
    return ids, np.where(ids % SHIFTED == 0, np.fmod(labels + 1, LABELS), labels), x


def found_in(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """tile, found: each task's windows of the slab's anchors, packed per tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab: Slab = shared.value
        tops = [slab.windows(a) for a in range(len(slab.ids))]
        mine: dict[int, np.ndarray] = {int(v): np.flatnonzero(slab.labels == v) for v in np.unique(slab.labels)}
        for batch in batches:
            ids, labels, x = labelled_rows(batch)
            if not len(ids):
                continue
            if x.shape[1] != slab.x.shape[1]:
                raise ValueError(f"a vector of length {x.shape[1]} among those of {slab.x.shape[1]}")
            if slab.positives is None:  # lists of one label each
                for label, anchors in mine.items():
                    at = np.flatnonzero(labels == label)
                    if len(at):
                        lists = Lists(x[at])
                        for a in anchors:
                            _search(lists, ids[at], None, int(slab.ids[a]), slab.x[a], tops[a])
                continue
            lists = Lists(x)
            for label, anchors in mine.items():
                other = labels != label
                if other.any():
                    for a in anchors:
                        _search(lists, ids, other, int(slab.ids[a]), slab.x[a], tops[a])
        tiles, found = pack(tops)
        yield pa.RecordBatch.from_arrays([pa.array(tiles, type=pa.int32()), pa.array(found, type=pa.binary())], ["tile", "found"])

    return rows.mapInArrow(run, "tile int, found binary")


def pack(tops: list[list[Top]]) -> tuple[list[int], list[bytes]]:
    """Rows (anchor in tile, window, score, id) of each tile that has any."""
    tiles, out = [], []
    for begin in range(0, len(tops), TILE):
        rows = [
            np.stack([np.full(len(t.ids), a), np.full(len(t.ids), w), t.scores, t.ids], axis=1)
            for a, windows in enumerate(tops[begin : begin + TILE])
            for w, t in enumerate(windows)
        ]
        whole = np.concatenate(rows) if rows else np.zeros((0, 4))
        if len(whole):
            tiles.append(begin // TILE)
            out.append(whole.astype("<i8").tobytes())
    return tiles, out


def merged(parts: Iterator[bytes], k: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The best k of each (anchor in tile, window), from the packed rows of all tasks one by one."""
    kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for part in parts:
        rows = np.frombuffer(part, dtype="<i8").reshape(-1, 4)
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        for piece in np.split(rows, starts[1:]):
            key = int(piece[0, 0]), int(piece[0, 1])
            old = kept.get(key)
            scores, ids = piece[:, 2], piece[:, 3]
            if old is not None:
                scores, ids = np.concatenate([old[0], scores]), np.concatenate([old[1], ids])
            kept[key] = best(scores, ids, k)
    return kept


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        yield from batch.column("found").to_pylist()


def positives_of(found: DataFrame, anchors: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of each anchor's positives: POSITIVES times the slab's anchors at most, which the driver sends out again."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = merged(_packed(batches), POSITIVES)
        tile = key[0].as_py()
        whole = [np.stack([np.full(len(ids), tile * TILE + a), scores, ids], axis=1) for (a, _), (scores, ids) in kept.items()]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(whole).astype("<i8").tobytes()], type=pa.binary())], ["found"])

    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * anchors
    for row in found.groupBy("tile").applyInArrow(run, "found binary").collect():
        rows = np.frombuffer(row["found"], dtype="<i8").reshape(-1, 3)
        for a in np.unique(rows[:, 0]):
            mine = rows[rows[:, 0] == a]
            out[a] = (mine[:, 1], mine[:, 2])
    return out


RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
RESULT_TYPES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def negatives_of(found: DataFrame, shared: Broadcast) -> DataFrame:
    """The result's rows of a slab."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab: Slab = shared.value
        kept = merged(_packed(batches), NEGATIVES)
        rows = []
        for (a, w), (scores, ids) in kept.items():
            at = key[0].as_py() * TILE + a
            score, positive = (int(v[w]) for v in slab.positives[at])
            rows += [(int(slab.ids[at]), positive, k + 1, n, score, s) for k, (s, n) in enumerate(zip(scores.tolist(), ids.tolist()))]
        kinds = [pa.int32() if name == "rank" else pa.int64() for name in RESULT]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], list(RESULT))

    return found.groupBy("tile").applyInArrow(run, RESULT_TYPES)


def slab_of(anchors: DataFrame) -> Slab | None:
    """A slab's rows on the driver; repeated rows once."""
    rows = anchors.dropDuplicates().toArrow().combine_chunks().to_batches()
    if not rows:
        return None
    parts = [labelled_rows(batch) for batch in rows]
    ids, labels, x = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((labels, ids))
    return Slab(ids[order], labels[order], x[order]) if len(ids) else None


def mine_negatives(embeddings: DataFrame, slab_size: int = SLAB) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", "embedding")
    anchors = rows.where((F.col("vec_id") % EVERY == 0) & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    slabs = -(-anchors.count() // slab_size)
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], RESULT_TYPES).write.parquet(path)
    for number in range(slabs):
        slab = slab_of(anchors.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(slabs)) == number))
        if slab is None:
            continue
        shared = spark.sparkContext.broadcast(slab)
        slab.positives = positives_of(found_in(rows, shared), len(slab.ids))
        shared.unpersist()
        windowed = spark.sparkContext.broadcast(slab)
        negatives_of(found_in(rows, windowed), windowed).write.mode("append").parquet(path)
        windowed.unpersist()
    return spark.read.schema(RESULT_TYPES).parquet(path)


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT DISTINCT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND b.vec_id <> a.vec_id),
positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
