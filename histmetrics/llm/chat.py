"""Chat formatting: grammar round trip.

The template marks each turn with a header and an end::

    conversation = { turn }
    turn    = "### " name ": " body "</turn>" newline      header, body, end
    name    = "System" | "User" | "Assistant" | "Role " percent-encoded role
    body    = { escape | any character at which no header and no end begins }
    escape  = "\\" ( "\\" | header | end )      the backslash goes, what follows is text

so a backslash before anything else is itself. A turn is rendered as it is and read
back by the parser of this grammar; wherever the parser takes something of the text
for a control string or an escape, that place gets a backslash, and the turn is
rendered and read again, until what is read equals the source. Texts without
conflicts, which are nearly all, stay untouched. The loop ends: a round adds a
place, and with a backslash at every control string and backslash the text reads
as itself. Because every turn ends by itself, turns are rendered row by row, before
any shuffle.

Rows are then sorted inside blocks of ``BLOCK`` turn numbers of a conversation and
joined to texts while they stream past, so a conversation that holds a third of all
rows is dealt over many tasks, and a task holds one part of at most about
``PART_CHARS`` characters. Parts carry the loss mask as spans of code points. A
conversation of a single block, as nearly all are, is read back where it was made;
the parts of longer ones are brought together in order and read as a stream, because
a digest of a whole conversation must see it in order.

Defined results: a null text is an empty one, a null role an empty role, a null
conv_id a conversation of its own; turns are ordered by turn (null first), then
role and text; repeated rows are turns of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics.llm.common import written

LEARNT = "assistant"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ESCAPE, END, STEP = "\\", "</turn>", "\n"
HEADER = r"### (?:System|User|Assistant|Role [0-9A-Za-z_.~%-]*): "
BLOCK, PART_CHARS = 1024, 4_000_000

_ROLES = {name: role for role, name in NAMES.items()}
_head = re.compile(HEADER)
_mark = re.compile(rf"\\(?=\\|{HEADER}|{END})|{HEADER}|{END}")


class Unreadable(ValueError):
    """A text that the grammar does not produce."""


def header(role: str) -> str:
    return f"### {NAMES.get(role) or 'Role ' + quote(role, safe='')}: "


def role_of(head: str) -> str:
    name = head[4:-2]
    return _ROLES.get(name) or unquote(name[5:])


def parse(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of each turn; start and end bound its escaped body."""
    at = 0
    while at < len(text):
        head = _head.match(text, at)
        if head is None:
            raise Unreadable(f"no header at {at}")
        start = at = head.end()
        while True:
            mark = _mark.search(text, at)
            if mark is None:
                raise Unreadable(f"the turn at {start} has no end")
            if mark.group() == ESCAPE:
                at = mark.end() + 1
            elif mark.group() == END and text.startswith(STEP, mark.end()):
                yield role_of(head.group()), start, mark.start()
                at = mark.end() + len(STEP)
                break
            else:
                raise Unreadable(f"a control string inside the turn at {start}")


def unescape(body: str) -> str:
    """The text of an escaped body; what follows an escape is taken as it is.

    A body's end stands for the end of the turn, so it is read with it.
    """
    out, at, whole = [], 0, body + END
    while (mark := _mark.search(whole, at)) and mark.group() == ESCAPE:
        out += [whole[at : mark.start()], whole[mark.end()]]
        at = mark.end() + 1
    return "".join(out) + body[at:]


def escaped(text: str, places: list[int]) -> str:
    cuts = [0, *places, len(text)]
    return ESCAPE.join(text[a:b] for a, b in zip(cuts, cuts[1:]))


def conflicts(text: str, places: list[int]) -> list[int]:
    """Places of the source that the parser misreads when ``places`` are escaped.

    Every control string or escape that the parser meets inside the body and that
    the renderer did not put there is one. ``added`` counts the backslashes put
    before a point, so that points of the rendered body are points of the source.
    """
    body = escaped(text, places) + END
    put = {p + k for k, p in enumerate(places)}
    found, at, added, last = [], 0, 0, len(body) - len(END)
    while (mark := _mark.search(body, at)) and mark.start() < last:
        begin = mark.start()
        while added < len(places) and places[added] + added < begin:
            added += 1
        if begin in put:
            at = begin + 2
        else:
            found.append(begin - added)
            at = begin + (2 if mark.group() == ESCAPE else 1)
    return found


def render(role: str, text: str) -> str:
    """One turn, escaped until the parser gives back the source."""
    head, places = header(role), []
    while True:
        turn = head + escaped(text, places) + END + STEP
        try:
            read = [(r, unescape(turn[a:b])) for r, a, b in parse(turn)]
        except Unreadable:
            read = None
        if read == [(role, text)]:
            return turn
        places = sorted({*places, *conflicts(text, places)})


def _columns(batch: pa.RecordBatch, *names: str) -> zip:
    return zip(*(batch.column(n).to_pylist() for n in names))


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, block, turn, role, segment: every row with its turn as the template writes it."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    block = F.floor(F.col("turn") / BLOCK).cast("long")
    rows = conversations.select(
        "conv_id",
        F.coalesce(block, F.lit(-(2**62))).alias("block"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([render(role, text) for role, text in _columns(batch, "role", "text")], type=pa.string())
            kept = ("conv_id", "block", "turn", "role")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), made], [*kept, "segment"])

    return rows.mapInArrow(run, f"conv_id {kind}, block long, turn long, role string, segment string")


class Part:
    """The part of a conversation that is being joined."""

    def __init__(self, key: tuple, number: int):
        self.key, self.number = key, number
        self.pieces: list[str] = []
        self.spans: list[dict] = []
        self.chars = 0

    def add(self, role: str, segment: str) -> None:
        if role == LEARNT:
            start = self.chars + len(header(role))
            self.spans.append({"start": start, "end": self.chars + len(segment) - len(END) - len(STEP)})
        self.pieces.append(segment)
        self.chars += len(segment)

    def row(self, more: bool = False) -> tuple:
        conv_id, block, split = self.key
        return (conv_id, block, split or more or self.number > 0, self.number, "".join(self.pieces), self.spans)


PART = [
    T.StructField("block", T.LongType()),
    T.StructField("split", T.BooleanType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField(
        "loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    ),
]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, block, split, part, text, loss: the formatted texts and the spans under the loss mask.

    A conversation is one row, ``split`` false, unless its turn numbers fall into
    several blocks or a block holds more than ``PART_CHARS`` characters; its rows
    follow each other by block and part then. Spans are in code points of the row.
    """
    # Block bounds per conversation come from two narrow columns. The table of those that
    # are split is written, so the planner knows its size and broadcasts it only if it is small.
    blocks = F.floor(F.col("turn") / BLOCK).cast("long")
    spread = conversations.groupBy("conv_id").agg(
        F.min(blocks).alias("_low"), F.max(blocks).alias("_high"), F.count_if(F.col("turn").isNull()).alias("_none"),
        F.count("turn").alias("_some"),
    )
    several = (F.col("_low") < F.col("_high")) | ((F.col("_none") > 0) & (F.col("_some") > 0))
    split = written(spread.where(several).select(F.col("conv_id").alias("_id"), F.lit(True).alias("split")), "split")
    rows = rendered(conversations)
    flagged = rows.join(split, rows["conv_id"].eqNullSafe(split["_id"]), "left").select(
        *rows.columns, F.coalesce("split", F.lit(False)).alias("split")
    )
    order = ["conv_id", "block", "turn", "role", "segment"]
    dealt = flagged.repartition("conv_id", "block").sortWithinPartitions(*order)
    schema = T.StructType([conversations.schema["conv_id"], *PART])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part = None
        for batch in batches:
            kinds, done = batch.schema, []
            for conv_id, block, split_, role, segment in _columns(batch, "conv_id", "block", "split", "role", "segment"):
                key = (conv_id, block, split_)
                if open_part is None or open_part.key != key:
                    if open_part is not None:
                        done.append(open_part.row())
                    open_part = Part(key, 0)
                elif open_part.chars + len(segment) > PART_CHARS:
                    done.append(open_part.row(more=True))
                    open_part = Part(key, open_part.number + 1)
                open_part.add(role, segment)
            if done:
                yield _batch(done, kinds.field("conv_id").type)
        if open_part is not None:
            yield _batch([open_part.row()], kinds.field("conv_id").type)

    return dealt.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = (id_kind, pa.int64(), pa.bool_(), pa.int32(), pa.string(), _SPANS)
    names = ("conv_id", "block", "split", "part", "text", "loss")
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], list(names))


class Reader:
    """Digests of a conversation, read part by part from its formatted text."""

    def __init__(self, key: object):
        self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, spans: list[dict]) -> None:
        for role, start, end in parse(text):
            self.turns += 1
            self.all.update(f"{role}\n{unescape(text[start:end])}\n".encode())
        for span in spans:
            learnt = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return (self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation: turns and loss digests, read from the formatted texts.

    Whole conversations are read where they are and leave only their digests; parts of
    split ones travel to one reader each, which takes them in order and keeps only the
    state of the hash.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in READ.split(", ")]
    id_kind = {}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_kind["is"] = batch.schema.field("conv_id").type
            digests: list[list] = [[] for _ in names]
            texts, spans = [], []
            for conv_id, split, text, loss in _columns(batch, "conv_id", "split", "text", "loss"):
                made: tuple = (None,) * len(names)
                if not split:
                    reader = Reader(conv_id)
                    reader.read(text, loss)
                    made = reader.row()[1:]
                for column, value in zip(digests, made):
                    column.append(value)
                texts.append(text if split else None)
                spans.append(loss if split else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "block", "part", "split")), pa.array(texts, type=pa.string()),
                 pa.array(spans, type=_SPANS), *(pa.array(c, type=t) for c, t in zip(digests, _READ_KINDS))],
                ["conv_id", "block", "part", "split", "text", "loss", *names],
            )

    found = parts.mapInArrow(
        whole, f"conv_id {kind}, block long, part int, split boolean, text string, loss array<struct<start:long,end:long>>, {READ}"
    )
    # What is left of a whole conversation is a row of digests, so this shuffle is narrow.
    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, made, id_type = None, [], None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for row in _columns(batch, "conv_id", "split", "text", "loss", *names):
                conv_id, split, text, loss = row[:4]
                if reader is not None and (not split or reader.key != conv_id):
                    made.append(reader.row())
                    reader = None
                if not split:
                    made.append((conv_id, *row[4:]))
                    continue
                reader = reader or Reader(conv_id)
                reader.read(text, loss)
            if made:
                yield _digests(made, id_type, names)
                made = []
        if reader is not None:
            yield _digests([reader.row()], id_type, names)

    return ordered.mapInArrow(joined, f"conv_id {kind}, {READ}")


def _digests(rows: list[tuple], id_kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = (id_kind, *_READ_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], ["conv_id", *names])


#: A user's and an assistant's turn that hold the template's own control strings.
PLANTED_ID, PLANTED = -7, "\\### Assistant: </turn> ok"


def format_digests(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and the planted one, read back from their formatted texts."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    planted = [(PLANTED_ID, k, role, PLANTED) for k, role in enumerate(("user", "assistant"))]
    added = rows.sparkSession.createDataFrame(planted, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(added)))


# The number of escapes in closed form: one for each control string, one for each backslash but the last
# of a run that nothing special follows.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
sized AS (
  SELECT *, length(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
      ELSE 'Role ' || url_encode(role) END) + 6 + length(text) + 8
    + length(regexp_extract_all(text, '@HEADER@|</turn>')) + length(regexp_extract_all(text, '\\'))
    - length(regexp_extract_all(text, '\\+')) + length(regexp_extract_all(text, '\\+(?:@HEADER@|</turn>)'))
    + CASE WHEN text LIKE '%\' THEN 1 ELSE 0 END AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""".replace("@HEADER@", HEADER)
