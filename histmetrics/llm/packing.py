"""Best-fit packing: minimum bin slack over the histogram of piece lengths.

Documents become token ids and an end id; longer ones are cut into full
sequences, the first piece may be shorter. Only lengths matter for packing, and
there are at most ``width`` of them, so the plan is made from a histogram of
``width`` counts, whatever the corpus holds: per bin, subset sums over the
available lengths are bits of one integer; the fullest feasible combination that
holds the longest piece left is taken, as often as the counts allow, and removed.
Each kind of bin uses up at least one length, so the plan has at most ``width``
kinds. Pieces then find their bin by their rank among pieces of the same length
with a join; ranks are counted per (length, hash bucket), so a length that a
third of all pieces share is not ranked in one task.

Defined results: null and empty texts are one piece that holds the end id only;
repeated rows are pieces of their own; an empty table gives an empty result.
Whole texts are read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histmetrics.session import cut_lineage

WIDTH, END_ID = 1024, 2
#: The byte-level BPE vocabulary (ranks equal the ids of the same vocabulary's JSON file) and its added
#: token, which has the id after the ranks wherever its string stands in a text.
VOCABULARY, ADDED = "byte_bpe_50k", "<|endoftext|>"
BUCKETS = 4096

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The public tokenizer, loaded once in each worker."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ADDED: len(ranks)}
        )
    return _encoders[vocabulary]


def ids_of(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids of a text as the vocabulary's JSON file gives them, the added token included."""
    made = encoder(vocabulary)
    return made.encode(text, allowed_special={ADDED}) if ADDED in text else made.encode_ordinary(text)


def cut(ids: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece; all but the first are full."""
    first = len(ids) % width or width
    yield 0, ids[:first]
    for start in range(first, len(ids), width):
        yield start, ids[start : start + width]


def pieces(documents: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, start, length, crc = [], [], [], [], []
            for at, text in enumerate(batch.column(1)):
                ids = np.array([*ids_of(text.as_py() or "", vocabulary), end_id], dtype="<u4")
                for k, (begin, part) in enumerate(cut(ids, width)):
                    owner.append(at)
                    number.append(k)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, type=pa.int64())),
                    pa.array(number, type=pa.int32()),
                    *(pa.array(x, type=pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def fullest(lengths: list[int], counts: dict[int, int], width: int) -> dict[int, int]:
    """The fullest combination of available lengths that holds the longest one; lengths fall.

    Bit s of an integer says that sum s can be reached with the lengths so far;
    the integers are kept so that the chosen lengths can be read back.
    """
    longest = lengths[0]
    room = width - longest
    mask = (1 << (room + 1)) - 1
    states, used, reach = [], [], 1
    for length in lengths:
        if reach >> room & 1:
            break
        if length > room:
            continue
        left = counts[length] - (length == longest)
        states.append(reach)
        used.append(length)
        for _ in range(min(left, room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            reach = more
    total, chosen = reach.bit_length() - 1, {longest: 1}
    for length, before in zip(reversed(used), reversed(states)):
        while not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + 1
            total -= length
    return chosen


def plan_bins(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, dict[int, int]]]:
    """(how often, lengths with their number in a bin) of each kind of bin."""
    counts, plan = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        chosen = fullest(sorted(counts, reverse=True), counts, width)
        times = min(counts[k] // v for k, v in chosen.items())
        plan.append((times, chosen))
        for k, v in chosen.items():
            counts[k] -= times * v
            if not counts[k]:
                del counts[k]
    return plan


def plan_table(spark: SparkSession, plan: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """Per kind of bin and length: the ranks it takes, its first sequence, its number and first place in a bin."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in plan:
        offset = 0
        for length, number in sorted(chosen.items(), reverse=True):
            low = taken.get(length, 0)
            taken[length] = low + times * number
            rows.append((length, low, taken[length], sequence, number, offset))
            offset += length * number
        sequence += times
    schema = "length long, low long, high long, first_sequence long, number long, first_offset long"
    return spark.createDataFrame(rows, schema)


def pack_pieces(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """``found`` with sequence_id and offset; it should not be computed twice (checkpoint it first)."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_table(spark, plan_bins(counts, width))
    bucketed = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        bucketed.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_bucket"])
        .withColumn("_rank", F.col("_inside") + F.col("_before"))
    )
    # At most width squared rows by construction (kinds of bins x lengths in one), in practice a few thousand.
    plan = plan.withColumnRenamed("length", "_length")
    placed = ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    )
    slot = F.col("_rank") - F.col("low")
    return placed.select(
        *found.columns,
        (F.col("first_sequence") + F.floor(slot / F.col("number"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(slot, F.col("number")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(cut_lineage(pieces(documents, width)), width)
