"""Chat formatting: round trips of awkward texts, long conversations, odd rows, SQL."""

import hashlib
import itertools
import random

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from histmetrics.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["\\", "</turn>", "### Assistant: ", "### User: ", "### Role a%20b: ", "#", "a", "\n", "### ", "é\U0001f600"]


def digests(turns):
    """Brute force: role and text of each turn in order."""
    learnt = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_every_short_mixture_of_control_strings_comes_back():
    for n in range(5):
        for parts in itertools.product(PIECES[:3] + ["a"], repeat=n):
            text = "".join(parts)
            turn = chat.render("assistant", text)
            assert [(r, chat.unescape(turn[a:b])) for r, a, b in chat.parse(turn)] == [("assistant", text)]


def test_long_mixtures_and_any_role_come_back():
    rng = random.Random(3)
    for _ in range(2000):
        turns = [
            (rng.choice(["user", "User", "", "a b: </turn>\n", "Role x"]), "".join(rng.choices(PIECES, k=rng.randint(0, 30))))
            for _ in range(3)
        ]
        text = "".join(chat.render(r, t) for r, t in turns)
        assert [(r, chat.unescape(text[a:b])) for r, a, b in chat.parse(text)] == turns


def test_texts_without_conflicts_stay_as_they_are():
    for text in ["", "plain", "a \\ b \\n", "### Heading", "</turn", "C:\\dir\\file", "# ### User:x"]:
        assert chat.render("user", text) == f"### User: {text}</turn>\n"


def test_parser_refuses_other_texts():
    for text in ["x", "### User: a", "### User: a</turn>", "### User: ### User: a</turn>\n", "### User: a</turn>\nx"]:
        with pytest.raises(chat.Unreadable):
            list(chat.parse(text))


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(9)
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", "first"), (2, 0, "user", None), (2, 1, "assistant", None)]
    rows += [(3, 0, None, "no role"), (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (4, None, "system", "s")]
    rows += [(5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"), (6, 0, "assistant", "x" * 300_000), (-5, -3, "user", "\\")]
    rows += [(7, k, rng.choice(["user", "assistant"]), "".join(rng.choices(PIECES, k=5))) for k in range(5000)]
    rows += [(8, k, "assistant", "y\\" * 100) for k in range(40)] + [(4, 5000, "assistant", "late")]
    return rows


def expected(rows):
    found = {}
    for conv_id, turn, role, text in rows:
        found.setdefault(conv_id, []).append((-(2**62) if turn is None else turn, role or "", text or ""))
    return {k: digests([(r, t) for _, r, t in sorted(v)]) for k, v in found.items()}


def test_digests_match_brute_force(spark, talk, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 2000)
    df = spark.createDataFrame(talk, SCHEMA).withColumn("split", F.lit("x")).withColumn("loss", F.lit(1)).repartition(5)
    got = {r["conv_id"]: r for r in chat.format_digests(df).collect()}
    want = expected([*talk, (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)])
    assert got.keys() == want.keys()
    for k, row in got.items():
        assert tuple(row)[1:5] == want[k], k
    assert got[-7]["formatted_chars"] == 2 * (len(chat.PLANTED) + 3 + 8) + len("### User: ") + len("### Assistant: ")


def test_long_conversations_are_dealt_and_masked(spark, talk, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 20_000)
    parts = chat.format_conversations(spark.createDataFrame(talk, SCHEMA)).collect()
    seven = sorted((r for r in parts if r["conv_id"] == 7), key=lambda r: (r["block"], r["part"]))
    assert len({r["block"] for r in seven}) == 5 and all(r["split"] for r in seven) and max(len(r["text"]) for r in seven) < 21_000
    learnt = "".join(chat.unescape(r["text"][s["start"] : s["end"]]) for r in seven for s in r["loss"])
    assert learnt == "".join(t for c, _, r, t in talk if c == 7 and r == "assistant")
    assert [r["split"] for r in parts if r["conv_id"] == 1] == [False]


def test_empty_table_has_the_planted_conversation_only(spark):
    got = chat.format_digests(spark.createDataFrame([], SCHEMA)).collect()
    assert [r["conv_id"] for r in got] == [-7]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_counts_the_same_escapes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k % 50, k, ["user", "assistant", "system", "a tool"][k % 4], "".join(rng.choices(PIECES, k=k % 12))) for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert difference(chat.format_digests(df), con, chat.SQL) is None
