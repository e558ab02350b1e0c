"""Suffix-array dedup: column-wise construction over pieces of many documents.

A byte goes when it is covered by a 50-byte string that also starts in a document
with a smaller id. Texts that are equal byte for byte are one class.

Pieces. Every 50-byte string belongs to its minimizer, the smallest hash of the
20-byte strings inside; equal strings have equal minimizers. A maximal run of
strings with one minimizer is a piece of 50 to 80 bytes (runs are cut at
``RUN`` strings). Pieces whose minimizer no other class has are left out: none of
their strings can repeat. The others go to the bucket of their minimizer, each
distinct piece once per batch with the smallest id that has it (``exchange``).

Column-wise construction. A bucket builds the Burrows-Wheeler transform and the
common prefixes of all its distinct pieces: in each round every piece inserts
its next symbol from the right. The place of the new suffix follows from the rank
of its symbol, its common prefix with either neighbour from the range minimum
between the neighbouring occurrences of that symbol. Transform and prefixes are an
external file, read and written in sequence in each round in the task's own
temporary folder, which goes with the task. Suffixes that share 50 bytes are
neighbours; the smallest id of each group goes back to the batches.

Defined results: null and empty texts have no bytes; a null id is larger than all
others and equal to itself; repeated rows (same id) do not remove each other;
texts under 50 bytes keep everything; an empty table gives an empty result.
Whole texts are read, strings are judged on the input.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmetrics.llm.exchange import POWERS, bucket_of, classes, key_of, members, mix, pack_sorted, parts, prefix_sums, unpack_sorted
from histmetrics.session import cut_lineage

SPAN, SEED_BYTES = 50, 20
#: Strings of a piece at most: those of 31 places share one 20-byte string.
RUN = SPAN - SEED_BYTES + 1
LAST_ID = np.iinfo(np.int64).max
NO_SYMBOL = 255


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Pieces:
    """Pieces of a batch's texts laid end to end: where they start, how many strings they hold, their minimizers."""

    def __init__(self, bodies: list[bytes]):
        self.body = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(bodies)), sizes)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        n = len(self.body) - SPAN + 1
        if n <= 0:
            self.start = self.strings = np.zeros(0, dtype=np.int64)
            self.seed = np.zeros(0, dtype=np.uint64)
            self.sums = np.zeros(1, dtype=np.uint64)
            return
        self.sums, (_, down) = prefix_sums(self.body), POWERS.upto(len(self.body) + 1)
        seeds = mix((self.sums[SEED_BYTES:] - self.sums[:-SEED_BYTES]) * down[: len(self.sums) - SEED_BYTES])
        least = window_minimum(seeds, RUN)
        inside = self.owner[:n] == self.owner[SPAN - 1 :]
        change = np.concatenate([[True], (least[1:] != least[:-1]) | (self.owner[1:n] != self.owner[: n - 1]) | (inside[1:] != inside[:-1])])
        first = np.flatnonzero(change)
        length = np.diff(np.append(first, n))
        first, length = first[inside[first]], length[inside[first]]
        cuts = -(-length // RUN)
        again = np.repeat(np.arange(len(first)), cuts)
        step = np.arange(len(again)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        self.start = first[again] + step * RUN
        self.strings = np.minimum(RUN, length[again] - step * RUN)
        # Minima are small numbers: mixed, so that they fall evenly into buckets.
        self.seed = mix(least[self.start])

    def texts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of some pieces laid end to end, and their lengths."""
        size = self.strings[chosen] + SPAN - 1
        at = np.repeat(self.start[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.body[at], size

    def hashes(self, chosen: np.ndarray) -> np.ndarray:
        _, down = POWERS.upto(len(self.body) + 1)
        begin, size = self.start[chosen], self.strings[chosen] + SPAN - 1
        return mix(mix((self.sums[begin + size] - self.sums[begin]) * down[begin]) ^ size.astype(np.uint64))


def _ids(first: list) -> np.ndarray:
    return np.array([LAST_ID if x is None else x for x in first], dtype=np.int64)


def ask_seeds(table: pa.Table, count: int) -> pa.Table:
    """A batch's distinct minimizers for each bucket; the last bit tells whether two of its classes have it."""
    keys, _, _, bodies = members(table)
    found = Pieces(bodies)
    owner = found.owner[found.start] if len(found.start) else found.start
    order = np.lexsort((owner, found.seed))
    seed, owner = found.seed[order], owner[order]
    new = np.concatenate([[True], seed[1:] != seed[:-1]])[: len(seed)]
    other = np.concatenate([[False], (seed[1:] == seed[:-1]) & (owner[1:] != owner[:-1])])[: len(seed)]
    distinct = seed[new]
    many = np.bincount(np.cumsum(new) - 1, other, len(distinct)) > 0
    edges = np.searchsorted(bucket_of(distinct, count), np.arange(count + 1))
    full = np.flatnonzero(np.diff(edges))
    batch = table["batch"][0].as_py()
    return pa.table(
        {
            "bucket": pa.array(full, type=pa.int32()),
            "batch": pa.array(np.full(len(full), batch), type=pa.int32()),
            "seeds": pa.array([pack_sorted(distinct[edges[k] : edges[k + 1]], count) for k in full], type=pa.binary()),
            "many": pa.array([np.packbits(many[edges[k] : edges[k + 1]]).tobytes() for k in full], type=pa.binary()),
        }
    )


def answer_seeds(table: pa.Table) -> pa.Table:
    """Which of each batch's minimizers another class has, as bits."""
    seeds = [unpack_sorted(b) for b in table["seeds"].to_pylist()]
    many = np.concatenate(
        [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=len(s)) for b, s in zip(table["many"].to_pylist(), seeds)]
    )
    every = np.concatenate(seeds)
    _, group, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = (times > 1) | (np.bincount(group, many, len(times)) > 0)
    bits, at, out = shared[group], 0, []
    for own in seeds:
        out.append(np.packbits(bits[at : at + len(own)]).tobytes())
        at += len(own)
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "bits": pa.array(out, type=pa.binary())})


def shared_pieces(found: Pieces, answers: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces whose minimizer is shared, one of each distinct piece by bucket, and the distinct number of each piece."""
    distinct, inverse = np.unique(found.seed, return_inverse=True)
    edges = np.searchsorted(bucket_of(distinct, count), np.arange(count + 1))
    shared = np.zeros(len(distinct), dtype=bool)
    for bucket, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
        a, b = edges[bucket], edges[bucket + 1]
        shared[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a)
    chosen = np.flatnonzero(shared[inverse])
    # By minimizer first, so that the distinct pieces are in the order of their buckets.
    order = np.lexsort((found.hashes(chosen), found.seed[chosen]))
    seed, text = found.seed[chosen][order], found.hashes(chosen)[order]
    new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])])[: len(order)]
    number = np.empty(len(chosen), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return chosen, chosen[order][new], number


def ask_pieces(left: pa.Table, right: pa.Table, count: int) -> pa.Table:
    """A batch's distinct shared pieces for each bucket with the smallest id that has them."""
    rows: dict[str, list] = {"bucket": [], "batch": [], "sizes": [], "ids": [], "text": []}
    if left.num_rows:
        _, first, _, bodies = members(left)
        found, ids = Pieces(bodies), _ids(first)
        chosen, distinct, number = shared_pieces(found, right, count)
        least = np.full(len(distinct), LAST_ID)
        np.minimum.at(least, number, ids[found.owner[found.start[chosen]]] if len(chosen) else least[:0])
        edges = np.searchsorted(bucket_of(found.seed[distinct], count), np.arange(count + 1))
        press = zstandard.ZstdCompressor(level=1).compress
        for bucket in np.flatnonzero(np.diff(edges)):
            part = slice(edges[bucket], edges[bucket + 1])
            text, size = found.texts(distinct[part])
            rows["bucket"].append(int(bucket))
            rows["batch"].append(left["batch"][0].as_py())
            rows["sizes"].append(size.astype(np.uint8).tobytes())
            rows["ids"].append(press(least[part].astype("<i8").tobytes()))
            rows["text"].append(press(text.tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({k: pa.array(v, type=t) for (k, v), t in zip(rows.items(), kinds)})


class Columns:
    """Transform and common prefixes of a collection of strings, built by inserting one symbol per string each round.

    The external file holds a pair for each suffix in order: the symbol before it
    and its common prefix with the suffix above it, up to SPAN.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, folder: str):
        self.text, self.size, self.end = text, size, np.cumsum(size)
        self.n = len(size)
        wide = bool((text == NO_SYMBOL).any())
        self.symbol, self.pair = (np.uint16, np.uint32) if wide else (np.uint8, np.uint16)
        self.none = NO_SYMBOL + wide
        self.bits = self.pair(0).nbytes * 4
        self.rows = 0
        with open(os.path.join(folder, "transform"), "w+b", buffering=0) as self.file:
            # Empty suffixes first, in the order of their strings.
            self._write(self._preceding(np.arange(self.n), 0).astype(self.pair))
            which = place = np.arange(self.n)
            for length in range(1, int(size.max(initial=0)) + 1):
                more = size[which] >= length
                which, place = self._insert(which[more], place[more], length)
            self.pairs = self._read()

    def _preceding(self, which: np.ndarray, length: int) -> np.ndarray:
        """The symbol before the suffix of ``length`` bytes of some strings."""
        out = np.full(len(which), self.none, dtype=self.symbol)
        more = self.size[which] > length
        out[more] = self.text[self.end[which[more]] - length - 1]
        return out

    def _write(self, pairs: np.ndarray) -> None:
        self.file.seek(0)
        left = memoryview(pairs).cast("B")
        while left.nbytes:
            left = left[self.file.write(left) :]
        self.rows = len(pairs)

    def _read(self) -> np.ndarray:
        self.file.seek(0)
        pairs = np.empty(self.rows, dtype=self.pair)
        left = memoryview(pairs).cast("B")
        while left.nbytes:
            left = left[self.file.readinto(left) :]
        return pairs

    def _split(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pairs.astype(self.symbol), (pairs >> self.bits).astype(np.uint8)

    def _insert(self, which: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Inserts the suffixes of ``length`` bytes of strings whose suffix of the round before is at ``place``.

        Strings come and go in the order of their places.
        """
        pairs = self._read()
        transform, prefixes = self._split(pairs)
        order = np.argsort(transform, kind="stable")
        moved = np.argsort(transform[place], kind="stable")  # by symbol, then place: the order of the new places
        which, place = which[moved], place[moved]
        symbol = transform[place]
        asked = np.zeros(len(order), dtype=bool)
        asked[place] = True
        own = np.flatnonzero(asked[order])
        new = self.n + own
        before, after = order[np.maximum(own - 1, 0)], order[np.minimum(own + 1, len(order) - 1)]
        has_before = (own > 0) & (transform[before] == symbol)
        has_after = (own + 1 < len(order)) & (transform[after] == symbol)
        padded = np.append(prefixes, np.uint8(0))
        common = np.zeros(len(new), dtype=np.uint8)
        common[has_before] = self._between(padded, before[has_before], place[has_before])
        grown = np.empty(len(pairs) + len(new), dtype=self.pair)
        old = np.ones(len(grown), dtype=bool)
        old[new] = False
        grown[old] = pairs
        grown[new] = self._preceding(which, length).astype(self.pair) | (common.astype(self.pair) << self.bits)
        below = new[has_after] + 1
        again = self._between(padded, place[has_after], after[has_after]).astype(self.pair)
        grown[below] = grown[below] & self.pair((1 << self.bits) - 1) | (again << self.bits)
        self._write(grown)
        return which, new

    @staticmethod
    def _between(padded: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """One more than the least common prefix over (low, high], up to SPAN; ranges of one symbol follow each other."""
        if not len(low):
            return np.zeros(0, dtype=np.uint8)
        # Backwards, where a range starts below the one before it ends, so that nothing between two ranges is read.
        pairs = np.stack([low[::-1] + 1, high[::-1] + 1], axis=1).ravel()
        least = np.minimum.reduceat(padded, pairs)[::2][::-1]
        return np.minimum(least + 1, SPAN).astype(np.uint8)

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each string of SPAN bytes of each piece: piece, offset, and the number of its group of equal ones."""
        transform, prefixes = self._split(self.pairs)
        order = np.argsort(transform, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        group = np.cumsum(prefixes < SPAN)
        place, out = np.arange(self.n), []
        for length in range(1, int(self.size.max(initial=0)) + 1):
            which = np.flatnonzero(self.size >= length)
            place[which] = self.n + rank[place[which]]
            if length >= SPAN:
                out.append((which, self.size[which] - length, group[place[which]]))
        return tuple(np.concatenate(x) for x in zip(*out))


def answer_pieces(table: pa.Table) -> pa.Table:
    """The smallest id that has each string of each batch's pieces, as runs of equal ids."""
    number: dict[bytes, int] = {}
    asked, least, unpress = [], [], zstandard.ZstdDecompressor().decompress
    for sizes, ids, text in zip(*(table[c].to_pylist() for c in ("sizes", "ids", "text"))):
        own, at, text = [], 0, unpress(text)
        for size, doc_id in zip(sizes, np.frombuffer(unpress(ids), dtype="<i8").tolist()):
            piece = text[at : at + size]
            k = number.setdefault(piece, len(number))
            if k == len(least):
                least.append(doc_id)
            elif doc_id < least[k]:
                least[k] = doc_id
            own.append(k)
            at += size
        asked.append(np.array(own, dtype=np.int64))
    size = np.array([len(p) for p in number], dtype=np.int64)
    with tempfile.TemporaryDirectory() as folder:
        columns = Columns(np.frombuffer(b"".join(number), dtype=np.uint8), size, folder)
        piece, offset, group = columns.groups()
    smallest = np.full(int(group.max(initial=0)) + 1, LAST_ID)
    np.minimum.at(smallest, group, np.array(least, dtype=np.int64)[piece])
    begins = np.cumsum(size - SPAN + 1) - (size - SPAN + 1)
    value = np.empty(int((size - SPAN + 1).sum()), dtype=np.int64)
    value[begins[piece] + offset] = smallest[group]
    # Runs of equal ids inside a piece.
    starts = np.zeros(len(value), dtype=bool)
    starts[begins] = True
    change = np.flatnonzero(starts | np.concatenate([[True], value[1:] != value[:-1]]))
    runs = np.diff(np.append(change, len(value))).astype(np.uint8)
    edges = np.searchsorted(change, np.append(begins, len(value)))
    counts, lengths, ids, press = [], [], [], zstandard.ZstdCompressor(level=1).compress
    for own in asked:
        n = edges[own + 1] - edges[own]
        at = np.repeat(edges[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        counts.append(n.astype(np.uint8).tobytes())
        lengths.append(runs[at].tobytes())
        ids.append(press(value[change[at]].astype("<i8").tobytes()))
    return pa.table(
        {
            "batch": table["batch"],
            "bucket": table["bucket"],
            "counts": pa.array(counts, type=pa.binary()),
            "runs": pa.array(lengths, type=pa.binary()),
            "ids": pa.array(ids, type=pa.binary()),
        }
    )


def removed(left: pa.Table, right: pa.Table, count: int) -> pa.Table:
    """key, first_id, n_removed, n_spans, kept_sha256 of a batch's classes. ``right`` holds both kinds of answers."""
    columns: dict[str, list] = {"key": [], "first_id": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    if left.num_rows:
        keys, first, _, bodies = members(left)
        found, own = Pieces(bodies), _ids(first)
        covered = np.zeros(len(found.body) + 1, dtype=np.int32)
        asked = right.filter(pc.is_valid(right["bits"]))
        told = right.filter(pc.is_null(right["bits"])).sort_by("bucket")
        chosen, distinct, number = shared_pieces(found, asked, count)
        if len(chosen):
            # Answers come by bucket, in the order of the distinct pieces.
            runs = np.frombuffer(b"".join(told["runs"].to_pylist()), dtype=np.uint8)
            unpress = zstandard.ZstdDecompressor().decompress
            ids = np.frombuffer(b"".join(map(unpress, told["ids"].to_pylist())), dtype="<i8")
            value = np.repeat(ids, runs)
            strings = found.strings[distinct]
            begins = np.cumsum(strings) - strings
            n = found.strings[chosen]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            smaller = value[np.repeat(begins[number], n) + inside]
            at = np.repeat(found.start[chosen], n) + inside
            at = at[smaller < own[found.owner[at]]]
            np.add.at(covered, at, 1)
            np.subtract.at(covered, at + SPAN, 1)
        gone = np.cumsum(covered[:-1]) > 0
        opens = gone & np.concatenate([[True], ~gone[:-1] | (found.owner[1:] != found.owner[:-1])])[: len(gone)]
        for k, (a, b) in enumerate(zip(found.begins, found.begins[1:])):
            columns["n_removed"].append(int(gone[a:b].sum()))
            columns["n_spans"].append(int(opens[a:b].sum()))
            columns["kept_sha256"].append(hashlib.sha256(found.body[a:b][~gone[a:b]].tobytes()).hexdigest())
        columns["key"], columns["first_id"] = keys, first
    kinds = (pa.binary(), left.schema.field("first_id").type, pa.int64(), pa.int64(), pa.string())
    return pa.table({k: pa.array(v, type=t) for (k, v), t in zip(columns.items(), kinds)})


def removed_by_class(batched: DataFrame, kind: str, count: int) -> DataFrame:
    """key, first_id, n_removed, n_spans, kept_sha256 of every class, for the document that has its smallest id."""
    seeds = batched.groupBy("batch").applyInArrow(lambda t: ask_seeds(t, count), "bucket int, batch int, seeds binary, many binary")
    bits = cut_lineage(seeds.groupBy("bucket").applyInArrow(answer_seeds, "batch int, bucket int, bits binary"))
    asked = (
        batched.groupBy("batch")
        .cogroup(bits.groupBy("batch"))
        .applyInArrow(lambda a, b: ask_pieces(a, b, count), "bucket int, batch int, sizes binary, ids binary, text binary")
    )
    told = cut_lineage(
        asked.groupBy("bucket").applyInArrow(answer_pieces, "batch int, bucket int, counts binary, runs binary, ids binary")
    )
    none = F.lit(None).cast("binary")
    both = bits.withColumns({"counts": none, "runs": none, "ids": none}).unionByName(told.withColumn("bits", none))
    return (
        batched.groupBy("batch")
        .cogroup(both.groupBy("batch"))
        .applyInArrow(lambda a, b: removed(a, b, count), f"key binary, first_id {kind}, n_removed long, n_spans long, kept_sha256 string")
    )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind, count = documents.schema["doc_id"].dataType.simpleString(), parts(documents)
    with classes(documents, count, lambda body: body or b"") as batched:
        by_class = cut_lineage(removed_by_class(batched, kind, count))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b or b"" for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([key_of(b) for b in bodies], type=pa.binary()),
                    pa.array([len(b) for b in bodies], type=pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in bodies], type=pa.string()),
                ],
                ["doc_id", "key", "n_bytes", "sha"],
            )

    keyed = documents.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(
        own, f"doc_id {kind}, key binary, n_bytes long, sha string"
    )
    done = keyed.join(by_class, "key", "left")
    copy = F.col("key").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= SPAN)
    return done.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
