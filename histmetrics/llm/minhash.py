"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words; a text of one to four words is one shingle. Texts with
the same words are one class. A shingle weighs its count in the text times a
smooth inverse document frequency between 1 and 1.5, counted over all documents.
For each of ``BANDS * ROWS`` hash functions a class samples the shingle (and the
level of its weight) that consistent weighted sampling gives, so two classes
sample the same with their weighted Jaccard similarity as probability; ``ROWS``
samples make a band. Classes that agree in a band are candidates, and only pairs
whose weighted Jaccard similarity is at least ``THRESHOLD`` are linked.

A band's bucket never emits its pairs. Its members are held against the one that
shares the most buckets, the heart of a group of copies. Members that have not come
to its group through any bucket are then compared with all members of theirs by
their samples, in blocks, and every pair that agrees in ``LEAST`` of them is verified
inside its block unless verified links already join it.

Counting goes through ``exchange``: batches of classes send distinct hashes to
buckets and get counts back, so no job has a row per shingle.

Defined results: null and empty texts and texts of white space link with nothing;
repeated rows and equal texts are one class; ties take the smallest doc_id; an
empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics.llm.common import annotate, written
from histmetrics.llm.components import components
from histmetrics.llm.exchange import (
    POWERS,
    batch_of,
    bucket_of,
    classes,
    key_of,
    members,
    mix,
    pack_sorted,
    parts,
    prefix_sums,
    unpack_sorted,
)
from histmetrics.session import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
#: Members of a block, and the share of samples that a pair in a block has to agree in.
CHUNK, LEAST = 512, 0.5
#: Shingles of a chunk's members together, so that long texts make smaller chunks.
WIDE = 1 << 22
TABLE_BITS = 16
#: Texts are hashed together up to this many bytes (a longer one alone).
TOGETHER = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts, in order, and the number of each shingle's text."""
    joined = b"\n".join(bodies)
    body = np.frombuffer(joined, dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[body], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    sums, (_, down) = prefix_sums(body), POWERS.upto(len(body) + 1)
    words = mix((sums[ends] - sums[starts]) * down[starts])
    first = np.cumsum([0] + [len(b) + 1 for b in bodies[:-1]])
    owner = np.searchsorted(first, starts, side="right") - 1
    if len(words) >= SHINGLE:
        joined_hash = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            joined_hash = joined_hash * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - SHINGLE + 1 + k]
        whole = owner[: len(joined_hash)] == owner[SHINGLE - 1 :]
        found, of = mix(joined_hash[whole]), owner[: len(joined_hash)][whole]
    else:
        found, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    counts = np.bincount(owner, minlength=len(bodies))
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        at = np.searchsorted(owner, short)
        extra = []
        for text, begin in zip(short, at):
            h = np.array([counts[text]], dtype=np.uint64)
            for w in words[begin : begin + counts[text]]:
                h = mix(h * np.uint64(31) ^ w)
            extra.append(h[0])
        found, of = np.concatenate([found, np.array(extra, dtype=np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    return found, of


def words_of(body: bytes | None) -> bytes:
    """A text's words with one space between them."""
    return b" ".join((body or b"").split())


def groups_of(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together."""
    begin = size = 0
    for at, body in enumerate(bodies):
        if at > begin and size + len(body) > TOGETHER:
            yield begin, at
            begin, size = at, 0
        size += len(body)
    if begin < len(bodies):
        yield begin, len(bodies)


def counted(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (sorted inside it), their counts, and where each text begins."""
    hashes, tf, begins, total = [], [], [0], 0
    for low, high in groups_of(bodies):
        found, of = shingles(bodies[low:high])
        edges = np.searchsorted(of, np.arange(high - low + 1))
        for a, b in zip(edges, edges[1:]):
            own = np.sort(found[a:b])
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
            hashes.append(own[new])
            tf.append(np.diff(np.append(new, len(own))).astype(np.int32))
            total += len(new)
            begins.append(total)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.array(begins)
    return np.concatenate(hashes), np.concatenate(tf), np.array(begins)


def smooth_idf(frequency: np.ndarray, documents: int) -> np.ndarray:
    """Between 1 (in all documents) and 1.5 (in none), so that a group of many copies still links."""
    return 1 + 0.5 * np.log((documents + 1) / (frequency + 1)) / np.log(documents + 1 + 1e-9)


_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def sampling_table(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of hash function ``number`` for each table index of a shingle."""
    if number not in _tables:
        rng = np.random.default_rng([2010, number])
        r, c = rng.gamma(2.0, 1.0, (2, 1 << TABLE_BITS))
        _tables[number] = (r.astype(np.float32), np.log(c).astype(np.float32), rng.random(1 << TABLE_BITS).astype(np.float32))
    return _tables[number]


def samples(hashes: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: one row per (non-empty) text, one column per hash function."""
    lengths = np.diff(begins)
    used = np.flatnonzero(lengths)
    out = np.zeros((len(lengths), BANDS * ROWS), dtype=np.uint64)
    if not len(used):
        return out
    starts, owner = begins[:-1][used], np.repeat(np.arange(len(used)), lengths[used])
    level = np.log(weights).astype(np.float32)
    for number in range(BANDS * ROWS):
        r, log_c, beta = sampling_table(number)
        odd = np.uint64((2 * number + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64) | 1)
        index = (hashes * odd >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        r, beta = r[index], beta[index]
        t = np.floor(level / r + beta)
        log_a = log_c[index] - r * (t - beta) - r
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == least[owner])
        at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]  # of equals the smallest hash
        out[used, number] = mix(hashes[at] ^ (t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)))
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    bands = np.zeros((len(sampled), BANDS), dtype=np.uint64)
    for row in range(ROWS):
        bands = mix(bands * np.uint64(31) + sampled[:, row::ROWS])
    return mix(bands ^ np.arange(BANDS, dtype=np.uint64))


def frequencies(batched: DataFrame, count: int) -> DataFrame:
    """batch, bucket, places, counts: which of a batch's hashes in a bucket other batches hold too, and all documents that do."""

    def ask(table: pa.Table) -> pa.Table:
        keys, _, n, bodies = members(table)
        hashes, _, begins = counted(bodies)
        weight = np.repeat(np.array(n, dtype=np.int64), np.diff(begins))
        distinct, inverse = np.unique(hashes, return_inverse=True)
        held = np.bincount(inverse, weight, len(distinct)).astype("<u4")
        edges = np.searchsorted(bucket_of(distinct, count), np.arange(count + 1))
        full = np.flatnonzero(np.diff(edges))
        batch = table["batch"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array(full, type=pa.int32()),
                "batch": pa.array(np.full(len(full), batch), type=pa.int32()),
                "hashes": pa.array([pack_sorted(distinct[edges[k] : edges[k + 1]], count) for k in full], type=pa.binary()),
                "held": pa.array([held[edges[k] : edges[k + 1]].tobytes() for k in full], type=pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        batch = table["batch"].to_numpy()
        hashes = [unpack_sorted(b) for b in table["hashes"].to_pylist()]
        held = np.concatenate([np.frombuffer(b, dtype="<u4") for b in table["held"].to_pylist()])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        new = np.concatenate([[True], every[order][1:] != every[order][:-1]])
        group = np.empty(len(every), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, held).astype("<u4")[group]
        places, counts, at, press = [], [], 0, zstandard.ZstdCompressor(level=1).compress
        for own in hashes:
            part, mine = total[at : at + len(own)], held[at : at + len(own)]
            more = part > mine
            places.append(np.packbits(more).tobytes())
            counts.append(press(part[more].tobytes()))
            at += len(own)
        return pa.table(
            {
                "batch": pa.array(batch, type=pa.int32()),
                "bucket": table["bucket"],
                "places": pa.array(places, type=pa.binary()),
                "counts": pa.array(counts, type=pa.binary()),
            }
        )

    asked = batched.groupBy("batch").applyInArrow(ask, "bucket int, batch int, hashes binary, held binary")
    return asked.groupBy("bucket").applyInArrow(answer, "batch int, bucket int, places binary, counts binary")


def weighed(left: pa.Table, right: pa.Table, count: int, documents: int):
    """A batch's classes with the weights of their shingles: keys, firsts, numbers, hashes, weights, begins."""
    keys, first, n, bodies = members(left)
    hashes, tf, begins = counted(bodies)
    weight = np.repeat(np.array(n, dtype=np.int64), np.diff(begins))
    distinct, inverse = np.unique(hashes, return_inverse=True)
    held = np.bincount(inverse, weight, len(distinct))
    edges = np.searchsorted(bucket_of(distinct, count), np.arange(count + 1))
    unpress = zstandard.ZstdDecompressor().decompress
    for bucket, places, counts in zip(*(right[c].to_pylist() for c in ("bucket", "places", "counts"))):
        more = np.unpackbits(np.frombuffer(places, dtype=np.uint8), count=edges[bucket + 1] - edges[bucket]).astype(bool)
        held[edges[bucket] : edges[bucket + 1]][more] = np.frombuffer(unpress(counts), dtype="<u4")
    return keys, first, n, hashes, tf * smooth_idf(held[inverse], documents), begins


def signatures(batched: DataFrame, answers: DataFrame, count: int, documents: int, kind: str) -> DataFrame:
    """key, first_id, n, number of distinct shingles, band keys and samples of every class."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"key": pa.array([], pa.binary()), "first_id": pa.array([], left["first_id"].type), "n": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "bands": pa.array([], pa.list_(pa.int64())), "samples": pa.array([], pa.list_(pa.int64()))})
        keys, first, n, hashes, weights, begins = weighed(left, right, count, documents)
        sampled = samples(hashes, weights, begins)
        bands = band_keys(sampled).view(np.int64)
        return pa.table(
            {
                "key": pa.array(keys, type=pa.binary()),
                "first_id": pa.array(first, type=left["first_id"].type),
                "n": pa.array(n, type=pa.int64()),
                "size": pa.array(np.diff(begins), type=pa.int64()),
                "bands": pa.array(list(bands), type=pa.list_(pa.int64())),
                "samples": pa.array(list(sampled.view(np.int64)), type=pa.list_(pa.int64())),
            }
        )

    return batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        run, f"key binary, first_id {kind}, n long, size long, bands array<long>, samples array<long>"
    )


def vectors(batched: DataFrame, answers: DataFrame, wanted: DataFrame, count: int, documents: int) -> DataFrame:
    """key and vector (packed hashes and weights) of the wanted classes."""
    chosen = wanted.select(batch_of(F.col("key"), count).alias("batch"), "key", F.lit(None).cast("binary").alias("places")).select(
        "batch", F.lit(-1).alias("bucket"), "key", "places", F.lit(None).cast("binary").alias("counts")
    )
    both = answers.select("batch", "bucket", F.lit(None).cast("binary").alias("key"), "places", "counts").unionByName(chosen)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        want = set(right["key"].to_pylist()) - {None}
        out_keys, out, press = [], [], zstandard.ZstdCompressor(level=1).compress
        if left.num_rows and want:
            real = right.filter(pc.is_valid(right["places"]))
            keys, _, _, hashes, weights, begins = weighed(left, real, count, documents)
            for key, a, b in zip(keys, begins, begins[1:]):
                if key in want:
                    out_keys.append(key)
                    out.append(pack_vector(hashes[a:b], weights[a:b], press))
        return pa.table({"key": pa.array(out_keys, type=pa.binary()), "vector": pa.array(out, type=pa.binary())})

    return batched.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(run, "key binary, vector binary")


def pack_vector(hashes: np.ndarray, weights: np.ndarray, press) -> bytes:
    """Rising hashes as differences and weights, byte by byte, pressed: few weights differ, and high bytes are small."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return press(steps.tobytes() + weights.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_vector(packed: bytes, unpress) -> tuple[np.ndarray, np.ndarray]:
    columns = np.frombuffer(unpress(packed), dtype=np.uint8).reshape(12, -1).T
    hashes = np.cumsum(np.ascontiguousarray(columns[:, :8]).view("<u8").ravel())
    return hashes, np.ascontiguousarray(columns[:, 8:]).view("<f4").ravel().astype(np.float64)


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two vectors."""
    (h1, w1), (h2, w2) = one, two
    at = np.minimum(np.searchsorted(h2, h1), max(0, len(h2) - 1))
    same = h2[at] == h1 if len(h2) else np.zeros(len(h1), dtype=bool)
    shared = np.minimum(w1[same], w2[at[same]]).sum()
    return float(shared / (w1.sum() + w2.sum() - shared))


def verified(pairs: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) with ``linked``: similar enough."""
    left = vector.select(F.col("key").alias("a"), F.col("vector").alias("va"))
    right = vector.select(F.col("key").alias("b"), F.col("vector").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            linked = [
                similarity(unpack_vector(x, unpress), unpack_vector(y, unpress)) >= threshold
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, type=pa.bool_())], ["a", "b", "linked"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(run, "a binary, b binary, linked boolean")


def _crowded(rows: DataFrame) -> DataFrame:
    """Members of buckets with two or more members."""
    held = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return rows.join(held, ["band", "value"])


def band_members(signed: DataFrame) -> DataFrame:
    """band, value, key and the number of members of every bucket that two or more classes share."""
    return cut_lineage(_crowded(signed.select("key", F.posexplode("bands").alias("band", "value"))))


def close_blocks(rows: DataFrame) -> DataFrame:
    """Members of pairs of chunks that have a pair to verify, with the number of their chunk's side.

    ``rows``: band, value, key, root, left, size, samples of whole buckets. Members
    are dealt by hash into chunks of about CHUNK members and WIDE shingles, and a
    chunk with members that are left meets every chunk of its bucket. Only members
    that have a partner in the other chunk come out (see ``_close``).
    """
    sizes = rows.groupBy("band", "value").agg(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("size") / WIDE).alias("_size"))
    dealt = rows.join(sizes, ["band", "value"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.ceil("_size")).cast("int"))
    # A chunk holds about CHUNK members by the hash, whatever the bucket's size.
    member = F.struct("key", "root", "left", "samples")
    chunks = cut_lineage(
        dealt.groupBy("band", "value", "chunk").agg(F.collect_list(member).alias("rows"), F.max("left").alias("open"))
    )
    one = chunks.where("open").select("band", "value", F.col("chunk").alias("c1"), F.col("rows").alias("r1"))
    two = chunks.select("band", "value", F.col("chunk").alias("c2"), F.col("rows").alias("r2"), F.col("open").alias("o2"))
    pairs = one.join(two, ["band", "value"]).where("c1 <= c2 OR NOT o2").select("band", "value", "c1", "c2", "r1", "r2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (band, value, c1, c2) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                one, two = _chunk(batch.column(4), at), _chunk(batch.column(5), at)
                close = _close(one, two, band, c1 == c2)
                if not close.any():
                    continue
                keys, roots, sides, taken = [], [], [], []
                for side, (part, held) in enumerate(((one, close.any(axis=1)), (two, close.any(axis=0)))):
                    rows = np.flatnonzero(held)
                    keys += [part[0][i] for i in rows]
                    roots += [part[1][i] for i in rows]
                    sides += [side] * len(rows)
                    taken.append(part[3][rows])
                flat = np.concatenate(taken)
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
                block = [pa.array([v] * len(keys), type=t) for v, t in zip((band, value, c1, c2), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*block, pa.array(sides, type=pa.int32()), pa.array(keys, type=pa.binary()), pa.array(roots, type=pa.binary()), pa.array(list(flat), type=pa.list_(pa.int64()))],
                    ["band", "value", "c1", "c2", "side", "key", "root", "samples"],
                )

    return pairs.mapInArrow(run, "band int, value long, c1 int, c2 int, side int, key binary, root binary, samples array<long>")


def close_links(blocks: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b): of each block's pairs the similar ones that join groups; every pair is verified or joined already."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        parts = []
        for number in (0, 1):
            rows = table.filter(pa.array(side == number)).combine_chunks()
            flat = rows["samples"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS * ROWS)
            parts.append((rows["key"].to_pylist(), rows["root"].to_pylist(), flat, rows["vector"].to_pylist()))
        band, same = table["band"][0].as_py(), table["c1"][0].as_py() == table["c2"][0].as_py()
        found = list(_joining(*parts, band, same, threshold))
        return pa.table({"a": pa.array([x for x, _ in found], type=pa.binary()), "b": pa.array([y for _, y in found], type=pa.binary())})

    return blocks.join(vector, "key").groupBy("band", "value", "c1", "c2").applyInArrow(run, "a binary, b binary")


def _chunk(column: pa.ListArray, at: int) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Keys, roots, left marks and samples of one chunk; samples stay packed."""
    begin, end = column.offsets[at].as_py(), column.offsets[at + 1].as_py()
    keys, roots, left, samples = (column.values.field(k) for k in ("key", "root", "left", "samples"))
    flat = samples.values.to_numpy()[begin * BANDS * ROWS : end * BANDS * ROWS]
    marks = left[begin:end].to_numpy(zero_copy_only=False)
    return keys[begin:end].to_pylist(), roots[begin:end].to_pylist(), marks, flat.reshape(-1, BANDS * ROWS)


def _agreeing(first: np.ndarray, second: np.ndarray, band: int) -> np.ndarray:
    """Pairs that agree in LEAST of their samples and share no band before this one (there they meet already)."""
    agree = np.zeros((len(first), len(second)), dtype=np.int16)
    for k in range(first.shape[1]):
        agree += first[:, k, None] == second[None, :, k]
    found = agree >= LEAST * first.shape[1]
    for earlier in range(band):
        shared = np.ones(found.shape, dtype=bool)
        for k in range(earlier * ROWS, earlier * ROWS + ROWS):
            shared &= first[:, k, None] == second[None, :, k]
        found &= ~shared
    return found


def _close(one: tuple, two: tuple, band: int, same: bool) -> np.ndarray:
    """Pairs of two chunks that have to be verified: they agree enough and are in different groups."""
    (_, roots1, _, first), (_, roots2, _, second) = one, two
    found = _agreeing(first, second, band)
    number = {r: k for k, r in enumerate({*roots1, *roots2})}
    found &= np.array([number[r] for r in roots1])[:, None] != np.array([number[r] for r in roots2])[None, :]
    if same:
        found[np.tril_indices(len(roots1))] = False
    return found


def _joining(one: tuple, two: tuple, band: int, same: bool, threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """Similar pairs of two parts (keys, roots, samples, vectors) that join groups; only similar pairs make one group of two."""
    (keys1, roots1, first, packed1), (keys2, roots2, second, packed2) = one, two
    unpress = zstandard.ZstdDecompressor().decompress
    left, right = [unpack_vector(v, unpress) for v in packed1], [unpack_vector(v, unpress) for v in packed2]
    found = _agreeing(first, second, band)
    if same:
        # Both sides are of one chunk: pairs are met once, by their keys.
        found &= np.array([[x < y for y in keys2] for x in keys1], dtype=bool).reshape(found.shape)
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    names, place = np.unique(np.concatenate([h for h, _ in right]), return_inverse=True)
    weights, totals = np.concatenate([w for _, w in right]), np.array([w.sum() for _, w in right])
    begins = np.cumsum([0] + [len(h) for h, _ in right])
    dense = np.zeros(len(names))
    for i, (hashes, own) in enumerate(left):
        mine = find(roots1[i])
        open_to = [j for j in np.flatnonzero(found[i]) if find(roots2[j]) != mine]
        if not open_to:
            continue
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        known = names[at] == hashes
        dense[at[known]] = own[known]
        for j in open_to:
            low, high = begins[j], begins[j + 1]
            shared = np.minimum(dense[place[low:high]], weights[low:high]).sum()
            # A cheap bound first; the pair itself is decided by ``similarity``.
            if shared < (threshold - 1e-6) * (own.sum() + totals[j] - shared) or find(roots1[i]) == find(roots2[j]):
                continue
            if similarity(left[i], right[j]) >= threshold:
                parent[find(roots1[i])] = find(roots2[j])
                yield keys1[i], keys2[j]
        dense[at[known]] = 0


def linked_roots(signed: DataFrame, shared: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """node and root of every class that is linked, over verified links between classes that share a band."""
    score = shared.groupBy("key").agg(F.sum("c").alias("score"))
    waiting = cut_lineage(shared.drop("c").join(score, "key"))
    # The member with the highest score; of equals the smallest key.
    heart = F.min_by("key", F.struct((-F.col("score")).alias("s"), F.col("key"))).alias("heart")
    hearts = waiting.groupBy("band", "value").agg(heart)
    met = cut_lineage(waiting.drop("score").join(hearts, ["band", "value"]))
    star = met.where(F.col("key") != F.col("heart")).select(F.col("heart").alias("a"), F.col("key").alias("b")).distinct()
    found = cut_lineage(verified(written(star, "pairs"), vector, threshold).where("linked").select("a", "b"))
    roots = components(found)

    # Members that no bucket has brought to the group of its heart, with all of that bucket.
    there = roots.withColumnsRenamed({"node": "heart", "root": "_to"})
    here = roots.withColumnsRenamed({"node": "key", "root": "_from"})
    grouped = met.join(there, "heart", "left").join(here, "key", "left").select(
        "band", "value", "key", F.coalesce("_from", "key").alias("root"), F.coalesce("_to", "heart").alias("_heart")
    )
    told = cut_lineage(grouped.withColumn("left", F.col("root") != F.col("_heart")).drop("_heart"))
    still = told.where("left").select("band", "value").distinct()
    rest = told.join(still, ["band", "value"], "left_semi").join(signed.select("key", "size", "samples"), "key")
    more = close_links(written(close_blocks(rest), "blocks"), vector, threshold)
    return components(found.unionByName(more))


def class_ids(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key (of a text's words) and class_id (smallest doc_id of its group) of every class."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    count, total = parts(documents), documents.count()
    with classes(documents, count, words_of) as batched:
        answers = cut_lineage(frequencies(batched, count))
        signed = cut_lineage(signatures(batched, answers, count, total, kind))
        shared = band_members(signed)
        vector = cut_lineage(vectors(batched, answers, shared.select("key").distinct(), count, total))
    roots = linked_roots(signed, shared, vector, threshold).withColumnRenamed("node", "key")
    rooted = signed.select("key", "first_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return rooted.join(smallest, "root").select("key", "class_id")


def classified(documents: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the kept columns), class_id and kept of every document.

    Rows with the id of their class are kept, so repeated rows of that id stay together.
    """
    names = sorted({*(keep or documents.columns), "doc_id"}, key=documents.columns.index)
    keyed = annotate(
        documents, "text", lambda texts: [[key_of(words_of(t)) for t in texts]], [T.StructField("key", T.BinaryType())], names
    )
    done = keyed.join(class_ids(documents, threshold), "key", "left")
    doc_id = F.col("row").getField("doc_id")
    class_id = F.coalesce("class_id", doc_id)
    return done.select("row", class_id.alias("class_id"), F.coalesce(doc_id == class_id, F.lit(True)).alias("kept"))


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its group), kept (one document of each group)."""
    done = classified(documents, threshold, ["doc_id"])
    return done.select(F.col("row").getField("doc_id").alias("doc_id"), "class_id", "kept")


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, with its own columns."""
    return classified(documents, threshold).where("kept").select("row.*")
