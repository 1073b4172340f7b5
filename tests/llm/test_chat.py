"""Chat formatting: exact round trips, the state machine and loss flags against plain Python."""

from __future__ import annotations

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from civicspan.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string, conversation string, segments string, one string, last string"
EXTRA = ("x",) * 4
CONTROLS = ["\\", "###", "### User: ", "### Assistant: ", "</turn>", "</turn>\n", "\\s", "\\h", "\\t", "<", "#", ": ", "\n", "a"]


def frame(spark, rows):
    return spark.createDataFrame([(*row, *EXTRA) for row in rows], SCHEMA)


def formatted(spark, rows):
    made = chat_format.format_conversations(frame(spark, rows))
    made = made.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    return {r["conversation"]: r for r in made.withColumn("loss", chat_format.loss_text(F.col("segments"))).collect()}


def test_any_texts_and_roles_come_back(spark):
    texts = ["".join(t) for n in range(4) for t in itertools.product(CONTROLS, repeat=n)]
    roles = ["user", "assistant", "User", "", "tool", "a: b", "x:", "\\o", "### User: ", "</turn>\n", "\\c", "system\n"]
    rows = [(i // 50, i, roles[i % len(roles)], t) for i, t in enumerate(texts)]
    rows += [(9000 + i, 0, r, t) for i, (r, t) in enumerate(itertools.product(roles, CONTROLS))]
    made = formatted(spark, rows)
    expected = {}
    for conversation, _, role, text in rows:
        expected.setdefault(conversation, []).append((role, text))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in made.items()} == expected
    for c, r in made.items():
        assert r["loss"] == "".join(t for role, t in expected[c] if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count("</turn>") == len(expected[c])


def test_defined_cases(spark):
    long_text = "word </turn> " * 200_000
    rows = [
        (1, None, "assistant", "last"),
        (1, 0, "user", None),
        (1, 1, None, "no role"),
        (2, 0, "user", "b"),
        (2, 0, "user", "a"),
        (2, 0, "assistant", "z"),
        (2, 0, "user", "a"),
        (None, 3, "user", "of none"),
        (None, 4, "assistant", long_text),
    ]
    made = formatted(spark, rows)
    turns = {c: [tuple(t) for t in r["turns"]] for c, r in made.items()}
    assert turns[1] == [("user", ""), ("", "no role"), ("assistant", "last")]
    assert turns[2] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert turns[None] == [("user", "of none"), ("assistant", long_text)]
    assert made[None]["loss"] == long_text and made[None]["valid"]
    assert formatted(spark, []) == {}


@pytest.mark.parametrize(
    ("roles", "state", "refused"),
    [
        ("ua", "answered", None),
        ("sua", "answered", None),
        ("uaua", "answered", None),
        ("uau", "asked", None),
        ("s", "primed", None),
        ("a", "refused", 0),
        ("uua", "refused", 1),
        ("uaa", "refused", 2),
        ("us", "refused", 1),
        ("uasua", "refused", 2),
        ("uat", "refused", 2),
    ],
)
def test_the_order_of_turns(spark, roles, state, refused):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    made = formatted(spark, [(1, i, names[r], "text") for i, r in enumerate(roles)])[1]
    assert (made["state"], made["refused_at"], made["valid"]) == (state, refused, state == "answered")


def test_only_assistant_texts_count(spark):
    made = formatted(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yes")])[1]
    assert [s["text"] for s in made["segments"] if s["loss"]] == ["yes"]
    assert made["formatted"] == "### User: hi</turn>\n### Assistant: yes</turn>\n"


def test_a_template_of_ones_own(spark):
    template = chat_format.Template(
        headers={"q": "[[q]] "},
        opening="[[",
        closing="]] ",
        end="[/]",
        loss=frozenset(),
        transitions={"start": {"q": "start"}},
        start="start",
        accepting=frozenset({"start"}),
        escape="~",
    )
    rows = [(1, 0, "q", "~[[q]] [/]"), (1, 1, "other]] ", "[/]\n~s")]
    made = chat_format.format_conversations(frame(spark, rows), template=template)
    row = made.withColumn("turns", chat_format.read_turns(F.col("formatted"), template)).first()
    assert [tuple(t) for t in row["turns"]] == [("q", "~[[q]] [/]"), ("other]] ", "[/]\n~s")]
    assert not any(s["loss"] for s in row["segments"]) and row["refused_at"] == 1


def test_the_query_on_the_planted_conversation(spark, tmp_path):
    frame(spark, [(5, 0, "user", "é\U0001f600"), (5, 1, "assistant", None)]).write.parquet(f"{tmp_path}/conversations.parquet")
    made = {r["conv_id"]: r for r in queries.queries()["op13_chat_format"](spark, str(tmp_path)).collect()}
    said = "\\### Assistant: </turn> ok"
    whole = f"user\n{said}\nassistant\n{said}\n"
    assert made[-7]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert (made[-7]["n_turns"], made[-7]["loss_chars"]) == (2, len(said))
    assert made[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert made[5]["loss_sha256"] == hashlib.sha256(b"").hexdigest() and made[5]["loss_chars"] == 0
    assert made[5]["formatted_chars"] == len("### User: é\U0001f600</turn>\n### Assistant: </turn>\n")
