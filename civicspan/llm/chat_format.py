"""Conversations as training text.

A template says how each role's turn begins, how a turn ends, which roles' texts count for the loss and in which order roles may
follow each other. The order is a finite-state machine that reads a conversation's roles: it names the state that it ends
in, and the first turn that it has no transition for. Every conversation is formatted, also one that it refuses;
callers filter on ``valid``. A turn becomes three segments, header, text and end, each with its loss flag.

Control strings inside texts and roles are replaced by escapes and an escape character by one of its own, so that a control string in the
output always is the template's, and ``read_turns`` gets back every role and text exactly.

Only DataFrame functions are used. Turns are shuffled once, by conversation; a conversation has to fit in one row, as its output is one.

Defined cases: a null text or role is empty; roles that the template doesn't name are formatted with their own name, without loss,
and the machine refuses them; turns with equal numbers are ordered by role and text, null numbers come last; repeated rows
are turns of their own; rows without an id are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import let

REFUSED = "refused"


@dataclass(frozen=True)
class Template:
    """``transitions`` gives for each state the next one for each role. All headers begin with ``opening``."""

    headers: Mapping[str, str]
    opening: str
    closing: str
    end: str
    loss: frozenset[str]
    transitions: Mapping[str, Mapping[str, str]]
    start: str
    accepting: frozenset[str]
    escape: str = "\\"

    def escapes(self) -> list[tuple[str, str]]:
        """Strings that may not be in a text and what stands for them; the escape character is first, and last to be undone."""
        return [(self.escape, f"{self.escape}s"), (self.opening, f"{self.escape}h"), (self.end, f"{self.escape}t")]


MARKED_TURNS = Template(
    headers={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    opening="###",
    closing=": ",
    end="</turn>",
    loss=frozenset({"assistant"}),
    transitions={
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="start",
    accepting=frozenset({"answered"}),
)


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda done, pair: F.replace(done, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def escaped(text: Column, template: Template = MARKED_TURNS) -> Column:
    return _replaced(text, template.escapes())


def unescaped(text: Column, template: Template = MARKED_TURNS) -> Column:
    return _replaced(text, [(short, whole) for whole, short in reversed(template.escapes())])


def _other(template: Template) -> str:
    """How the header of a role begins that the template doesn't name; no escaped text holds this escape."""
    return f"{template.opening} {template.escape}o"


def _role_escapes(template: Template) -> list[tuple[str, str]]:
    return [*template.escapes(), (template.closing, f"{template.escape}c")]


def header(role: Column, template: Template = MARKED_TURNS) -> Column:
    own = F.concat(F.lit(_other(template)), _replaced(role, _role_escapes(template)), F.lit(template.closing))
    return reduce(lambda rest, known: F.when(role == known[0], F.lit(known[1])).otherwise(rest), template.headers.items(), own)


def final_state(roles: Column, template: Template = MARKED_TURNS) -> Column:
    """``state, refused_at`` after the machine has read the roles: the number from 0 of the turn that it refused, or null."""
    moves = [(f"{state}>{role}", after) for state, by_role in template.transitions.items() for role, after in by_role.items()]
    table = F.create_map(*[F.lit(x) for move in moves for x in move])
    first = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("refused_at"), F.lit(0).alias("at"))

    def step(done: Column, role: Column) -> Column:
        known = F.coalesce(table[F.concat(done["state"], F.lit(">"), role)], F.lit(REFUSED))
        state = F.when(done["state"] == REFUSED, F.lit(REFUSED)).otherwise(known)
        newly = (state == REFUSED) & done["refused_at"].isNull()
        return F.struct(
            state.alias("state"),
            F.when(newly, done["at"]).otherwise(done["refused_at"]).alias("refused_at"),
            (done["at"] + 1).alias("at"),
        )

    return F.aggregate(roles, first, step)


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template = MARKED_TURNS,
) -> DataFrame:
    """A row of each conversation: ``conversation, segments, formatted, valid, state, refused_at``.

    ``segments`` holds ``text, loss`` of each segment in order, ``formatted`` is all their texts in a row.
    """
    place = [F.col(order).isNull().alias("last"), F.col(order).alias("at")]
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((role, "role"), (text, "text"))]
    rows = turns.select(F.col(conversation).alias("conversation"), F.struct(*place, *said).alias("one"))
    ordered = rows.groupBy("conversation").agg(F.array_sort(F.collect_list("one")).alias("turns"))

    def pieces(turn: Column) -> Column:
        counts = turn["role"].isin(*sorted(template.loss)) if template.loss else F.lit(False)
        each = [
            (header(turn["role"], template), F.lit(False)),
            (escaped(turn["text"], template), counts),
            (F.lit(f"{template.end}\n"), F.lit(False)),
        ]
        return F.array(*[F.struct(said.alias("text"), flag.alias("loss")) for said, flag in each])

    made = ordered.select(
        "conversation",
        F.flatten(F.transform("turns", pieces)).alias("segments"),
        final_state(F.transform("turns", lambda t: t["role"]), template).alias("read"),
    )
    return made.select(
        "conversation",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("read.state").isin(*sorted(template.accepting)).alias("valid"),
        F.col("read.state").alias("state"),
        F.col("read.refused_at").alias("refused_at"),
    )


def read_turns(formatted: Column, template: Template = MARKED_TURNS) -> Column:
    """``role, text`` of every turn of a formatted conversation, in order."""
    pieces = F.split(formatted, f"\\Q{template.end}\n\\E", -1)

    def turn(piece: Column) -> Column:
        other = _other(template)
        name = F.split_part(F.substr(piece, F.lit(len(other) + 1)), F.lit(template.closing), F.lit(1))
        own = _replaced(name, [(short, of) for of, short in reversed(_role_escapes(template))])
        own_length = F.char_length(name) + F.lit(len(other) + len(template.closing))
        known = [(F.startswith(piece, F.lit(head)), role, len(head)) for role, head in template.headers.items()]
        role = reduce(lambda rest, k: F.when(k[0], F.lit(k[1])).otherwise(rest), known, own)
        length = reduce(lambda rest, k: F.when(k[0], F.lit(k[2])).otherwise(rest), known, own_length)
        return F.struct(role.alias("role"), unescaped(F.substr(piece, length + 1), template).alias("text"))

    return let(pieces, lambda all_: F.transform(F.slice(all_, F.lit(1), F.size(all_) - 1), turn))


def loss_text(segments: Column, template: Template = MARKED_TURNS) -> Column:
    """All text under the loss mask, as it was said."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template)), "")
