"""Embedding near-dedup: sorted projection passes.

Equal vectors of a label are one class. In each pass the classes are ordered
lexicographically by label and a string of random hyperplane signs, every vector
is compared with its next ``window`` neighbours in double precision, and pairs
with cosine >= ``threshold`` are united; a task passes on only as many links as
join what it has united. Links of all passes make components.

Windows do not find all links: neighbours are bounded, groups are not, and in a
dense label the order says little. So links are counted exactly over whole labels:
a label's vectors, signed about their mean, are dealt into cells of about ``CHUNK``
vectors, and each pair of cells that the angle of their centres does not rule out
is one block product. What it links joins the windows' links, so the result does
not depend on what the windows see. No pair of vectors is ever written, but the
work of a label that no angle divides grows with the square of its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label or id, link with nothing (n_links 0,
component_id their own id, kept true); vectors of different lengths do not link;
repeated rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmetrics.llm.components import components
from histmetrics.session import cut_lineage

THRESHOLD, PASSES, WINDOW, BITS, CHUNK = 0.98, 16, 32, 48, 1024


def keyed(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, key and the vector's bytes; key and bytes are null for a vector that links with nothing."""
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    width = "<f4" if kind == "float" else "<f8"
    vec_kind, label_kind = (embeddings.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = [], []
            for vec_id, label, vector in zip(*(batch.column(k) for k in range(3))):
                key = body = None
                if vec_id.is_valid and label.is_valid and vector.is_valid and len(vector) and not vector.values.null_count:
                    x = vector.values.to_numpy(zero_copy_only=False).astype(width) + 0  # -0.0 becomes 0.0
                    if np.isfinite(x).all() and x.any():
                        body = x.tobytes()
                        key = hashlib.sha256(f"{label.as_py()}|{len(x)}|".encode() + body).digest()[:16]
                keys.append(key)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, type=pa.binary()), pa.array(bodies, type=pa.binary())],
                ["vec_id", "label", "key", "body"],
            )

    return embeddings.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id {vec_kind}, label {label_kind}, key binary, body binary"
    )


def unit(bodies: list[bytes], width: str) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    x = np.frombuffer(b"".join(bodies), dtype=width).reshape(len(bodies), -1).astype(np.float64)
    # Scaled first, so that squares of very large or small components stay finite.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signs(x: np.ndarray, number: int) -> np.ndarray:
    """Codes of BITS random hyperplane signs, first sign highest."""
    planes = np.random.default_rng([x.shape[1], number]).normal(size=(x.shape[1], BITS))
    return ((x @ planes) > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


class Forest:
    """Union-find over the rows of one batch of neighbours."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def window_links(classes: DataFrame, width: str, threshold: float, passes: int, window: int) -> DataFrame:
    """Links (a, b) that join what the windows of all passes unite."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            sizes = np.array([len(b) for b in bodies])
            for number in range(passes):
                code = np.zeros(len(bodies), dtype=np.int64)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    code[rows] = signs(unit([bodies[i] for i in rows], width), number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), number, dtype=np.int32)), batch.column("label"), pa.array(code), batch.column("key"), batch.column("body")],
                    ["pass", "label", "code", "key", "body"],
                )

    label_kind = classes.schema["label"].dataType.simpleString()
    spread_out = classes.select("label", "key", "body").mapInArrow(
        spread, f"pass int, label {label_kind}, code long, key binary, body binary"
    )
    order = ["pass", "label", "code", "key"]
    ordered = spread_out.repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last ``window`` rows of the batch before
        for batch in batches:
            table = pa.Table.from_batches([batch])
            fresh = 0
            if held is not None:
                fresh, table = held.num_rows, pa.concat_tables([held, table])
            number, label = table["pass"].to_numpy(), np.array(table["label"].to_pylist(), dtype=object)
            key, bodies = table["key"].to_pylist(), table["body"].to_pylist()
            sizes = np.array([len(b) for b in bodies])
            forest, found = Forest(len(key)), []
            starts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (label[1:] != label[:-1]) | (sizes[1:] != sizes[:-1])) + 1), len(key)]
            for low, high in zip(starts, starts[1:]):
                if high - low < 2:
                    continue
                x = unit(bodies[low:high], width)
                for step in range(1, min(window, high - low - 1) + 1):
                    cosine = np.einsum("ij,ij->i", x[:-step], x[step:])
                    for i in np.flatnonzero(cosine >= threshold):
                        a, b = int(i) + low, int(i) + low + step
                        if b >= fresh and forest.join(a, b):
                            found.append((key[a], key[b]))
            held = table.slice(max(0, table.num_rows - window))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.binary()), pa.array(b, type=pa.binary())], ["a", "b"])

    return ordered.mapInArrow(compare, "a binary, b binary")


def cells(classes: DataFrame, width: str) -> DataFrame:
    """label, size, region, part, rows, centre and reach: chunks of near CHUNK vectors of one label and length.

    A label's vectors are dealt by the first signs of their sorted code, as many as
    its size asks for, taken about the label's mean; a region that is still large is
    dealt by hash. ``reach`` is the largest angle of a cell's vectors to its centre.
    """
    by = ["label", "size"]

    def mean(table: pa.Table) -> pa.Table:
        x = np.array([np.frombuffer(b, dtype="<f8") for b in table["sums"].to_pylist()]).sum(axis=0)
        total = sum(table["n"].to_pylist())
        return pa.table({"label": table["label"][:1], "size": table["size"][:1], "mean": pa.array([(x / total).tobytes()], type=pa.binary()), "total": pa.array([total], type=pa.int64())})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault((label, len(body)), []).append(body)
            made = [(k, unit(v, width).sum(axis=0).tobytes(), len(v)) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k, _, _ in made], type=batch.schema.field(0).type),
                    pa.array([k[1] for k, _, _ in made], type=pa.int32()),
                    pa.array([s for _, s, _ in made], type=pa.binary()),
                    pa.array([n for _, _, n in made], type=pa.int64()),
                ],
                ["label", "size", "sums", "n"],
            )

    kind = classes.schema["label"].dataType.simpleString()
    summed = classes.select("label", "body").mapInArrow(partial, f"label {kind}, size int, sums binary, n long")
    means = cut_lineage(summed.groupBy(*by).applyInArrow(mean, f"label {kind}, size int, mean binary, total long"))
    told = classes.withColumn("size", F.length("body")).join(means, by).select(*by, "key", "n", "body", "mean", "total")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = np.zeros(batch.num_rows, dtype=np.int64)
            places: dict[tuple, list[int]] = {}
            bodies = batch.column(4).to_pylist()
            for at, group in enumerate(zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist())):
                places.setdefault(group, []).append(at)
            for (_, centre, total), rows in places.items():
                bits = min(BITS, max(0, int(np.ceil(np.log2(total / CHUNK)))))
                x = unit([bodies[i] for i in rows], width) - np.frombuffer(centre, dtype="<f8")
                region[rows] = signs(x, 0) >> (BITS - bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(region)], ["label", "size", "key", "n", "body", "region"])

    dealt = cut_lineage(told.mapInArrow(deal, f"label {kind}, size int, key binary, n long, body binary, region long"))
    held = dealt.groupBy(*by, "region").agg(F.count(F.lit(1)).alias("_held"))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("_held") / CHUNK)).cast("int").alias("part")
    member = F.struct("key", "n", "body")
    # A cell holds about CHUNK vectors by the hash, whatever the region's size.
    made = dealt.join(held, [*by, "region"]).select(*by, "region", part, member.alias("m")).groupBy(*by, "region", "part")
    made = made.agg(F.collect_list("m").alias("rows")).select(*by, "region", "part", "rows")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, reach = [], []
            for rows in batch.column(4):
                x = unit([r["body"] for r in rows.as_py()], width)
                middle = x.mean(axis=0)
                size = np.sqrt(middle @ middle)
                middle = middle / size if size > 1e-9 else x[0]
                centres.append(middle)
                reach.append(float(np.arccos(np.clip((x @ middle).min(), -1, 1))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tolist() for c in centres], type=pa.list_(pa.float64())), pa.array(reach, type=pa.float64())],
                [*batch.schema.names, "centre", "reach"],
            )

    rows = "array<struct<key:binary,n:bigint,body:binary>>"
    return made.mapInArrow(
        bound, f"label {kind}, size int, region long, part int, rows {rows}, centre array<double>, reach double"
    )


def exact_links(classes: DataFrame, width: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join what is united, and key and linked: the vectors of other classes that each is linked with.

    Every two cells of a label are multiplied, unless the angle of their centres
    shows that no pair in them can be linked; so nothing is missed.
    """
    made = cut_lineage(cells(classes, width))
    names = ["region", "part", "centre", "reach"]
    bounds = made.select("label", "size", *names)
    one = bounds.withColumnsRenamed({c: f"{c}1" for c in names})
    two = bounds.withColumnsRenamed({c: f"{c}2" for c in names})
    first, second = F.struct("region1", "part1"), F.struct("region2", "part2")
    dot = F.aggregate(F.zip_with("centre1", "centre2", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    # A little wider than the threshold's angle, as angles are rounded.
    widest = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    near = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))) <= F.col("reach1") + F.col("reach2") + F.lit(widest)
    met = one.join(two, ["label", "size"]).where((first <= second) & near)
    met = cut_lineage(met.select("label", "size", "region1", "part1", "region2", "part2"))
    by = ["label", "size"]
    left = made.select(*by, F.col("region").alias("region1"), F.col("part").alias("part1"), F.col("rows").alias("r1"))
    right = made.select(*by, F.col("region").alias("region2"), F.col("part").alias("part2"), F.col("rows").alias("r2"))
    pairs = met.join(left, [*by, "region1", "part1"]).join(right, [*by, "region2", "part2"])
    pairs = pairs.select(((F.col("region1") == F.col("region2")) & (F.col("part1") == F.col("part2"))).alias("same"), "r1", "r2")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, r1, r2 in zip(*(batch.column(k) for k in range(3))):
                one, two = r1.as_py(), r2.as_py()
                n1, n2 = (np.array([r["n"] for r in rows], dtype=np.int64) for rows in (one, two))
                linked = unit([r["body"] for r in one], width) @ unit([r["body"] for r in two], width).T >= threshold
                if same.as_py():
                    np.fill_diagonal(linked, False)
                    keys, found = [r["key"] for r in one], linked @ n2
                else:
                    keys = [r["key"] for r in (*one, *two)]
                    found = np.concatenate([linked @ n2, n1 @ linked])
                a, b, forest, shift = [], [], Forest(len(one) + len(two)), 0 if same.as_py() else len(one)
                for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
                    if forest.join(i, j + shift):
                        a.append(one[i]["key"])
                        b.append(two[j]["key"])
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in some] + a, type=pa.binary()),
                        pa.array([None] * len(some) + b, type=pa.binary()),
                        pa.array([int(found[i]) for i in some] + [None] * len(a), type=pa.int64()),
                    ],
                    ["a", "b", "linked"],
                )

    both = cut_lineage(pairs.mapInArrow(count, "a binary, b binary, linked long"))
    counted = both.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("linked").alias("linked"))
    return both.where("b IS NOT NULL").select("a", "b"), counted


def near_vectors(
    embeddings: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    width = "<f4" if embeddings.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = cut_lineage(keyed(embeddings))
    classes = cut_lineage(
        rows.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("body").alias("body"))
    )
    links = window_links(classes, width, threshold, passes, window)
    rest, linked = exact_links(classes.select("label", "key", "n", "body"), width, threshold)
    roots = components(links.unionByName(rest))
    members = classes.join(roots.withColumnRenamed("node", "key"), "key")
    smallest = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    grouped = members.join(smallest, "root").join(linked, "key", "left").select("key", "component_id", "linked")
    known = classes.select("key", "n", "first_id").join(grouped, "key", "left")
    done = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "first_id", "vec_id").cast("long")
    return done.select(
        "vec_id",
        F.coalesce(F.col("n") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
