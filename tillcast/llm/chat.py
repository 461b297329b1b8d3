"""Chat formatting by a finite-state machine over roles and a declarative template.

The machine walks the turns of a conversation in order. The template says which role may follow in
which state, which marks stand around a turn and whether its text counts for the loss. The
result is a list of text segments, each with its loss flag, whose texts joined are the
formatted conversation. Control strings inside texts are escaped by a backslash after their
first character, which can be undone, so that marks in the output are always the template's.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_START, _ERROR = "start", "error"


@dataclass(frozen=True)
class Turn:
    """Marks around the text of a role's turn, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns``: by role; ``other``: marks for the name and the text of any other role.
    ``follows``: for each state the roles that may come and the state that each leads to.
    ``ends``: states in which a conversation is complete."""

    turns: dict[str, Turn]
    other: tuple[str, str, str]
    follows: dict[str, dict[str, str]]
    ends: tuple[str, ...]
    marks: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = {m for t in self.turns.values() for m in (t.before, t.after)} | {*self.other}
        object.__setattr__(self, "marks", tuple(sorted(marks - {""}, key=lambda m: (-len(m), m))))
        starts = {m[0] for m in self.marks}
        if any(c in starts or c == "\\" for m in self.marks for c in m[1:]):
            raise ValueError("a mark's first character must not occur later in any mark")
        closing = {t.after for t in self.turns.values()} | {self.other[2]}
        opening = {t.before for t in self.turns.values()} | {*self.other[:2]}
        if closing & opening or sum(t.before == "" for t in self.turns.values()) > 1:
            raise ValueError("marks must tell where a turn ends and which role it has")

    def _inside(self, backslashes: str) -> str:
        """Pattern for the place after the first character of a control string."""
        by_start = itertools.groupby(sorted(self.marks), key=lambda m: m[0])
        return "|".join(
            f"(?<={re.escape(c)}){backslashes}(?=\\\\*(?:{'|'.join(re.escape(m[1:]) for m in ms)}))"
            for c, ms in by_start
        )

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._inside(""), r"\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._inside(r"\\"), "")

    def turn_pattern(self) -> str:
        """Pattern of one formatted turn."""
        named, text, end = map(re.escape, self.other)
        turns = sorted(self.turns.values(), key=lambda t: t.before == "")
        known = [f"{re.escape(t.before)}.*?{re.escape(t.after)}" for t in turns]
        return "(?s)" + "|".join([f"{named}.*?{text}.*?{end}", *known])


#: Marks in square brackets; the assistant's turn has an end mark alone.
INSTRUCTIONS = Template(
    turns={
        "system": Turn("[SYS]", "[/SYS]"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("", "</s>", loss=True),
    },
    other=("[ROLE]", "[TEXT]", "[/TEXT]"),
    follows={
        _START: {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    ends=("answered",),
)


def _segments(template: Template, turn: Column) -> Column:
    """Segments of one turn: struct(text, loss); empty ones are left out."""
    text = template.escape(turn["text"])

    def segments(before: Column, after: Column, loss: bool) -> Column:
        parts = [(before, False), (text, loss), (after, False)]
        made = F.array(*(F.struct(t.alias("text"), F.lit(x).alias("loss")) for t, x in parts))
        return F.filter(made, lambda s: s["text"] != "")

    named, begun, end = template.other
    role = template.escape(turn["role"])
    chosen = segments(F.concat(F.lit(named), role, F.lit(begun)), F.lit(end), False)
    for name, marks in template.turns.items():
        own = segments(F.lit(marks.before), F.lit(marks.after), marks.loss)
        chosen = F.when(turn["role"] == name, own).otherwise(chosen)
    return chosen


def format_chats(
    turns: DataFrame,
    template: Template = INSTRUCTIONS,
    id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Per conversation: id, segments (array of struct(text, loss)), formatted, state (after the
    last turn), valid (no role came out of turn), complete (valid, and the state is one of the
    template's ends), first_bad_turn (place, from 0, of the first role out of turn, or null).

    Turns are ordered by turn number, null first; ties by role, then text. A null role or text
    is empty; a role that the template doesn't know is formatted with its name and is out of turn.
    Conversations out of turn are formatted all the same and flagged. Rows with a null id are one
    conversation. An empty table gives no rows. Other columns are not read. A conversation is one
    row of the result, so its turns meet in one task; nothing else has to fit there.
    """
    chosen = turns.select(
        turns[id].alias("id"),
        F.struct(
            turns[turn].alias("turn"),
            F.coalesce(turns[role], F.lit("")).alias("role"),
            F.coalesce(turns[text], F.lit("")).alias("text"),
        ).alias("said"),
    )
    grouped = chosen.groupBy("id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    steps = [
        x
        for state, roles in template.follows.items()
        for name, after in roles.items()
        for x in (F.lit(f"{state} {name}"), F.lit(after))
    ]
    follow = F.create_map(*steps)
    begin = F.struct(
        F.lit(_START).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")
    )

    def walk(reached: Column, said: Column) -> Column:
        key = F.concat(reached["state"], F.lit(" "), said["role"])
        state = F.coalesce(F.try_element_at(follow, key), F.lit(_ERROR))
        bad = F.when(state == _ERROR, F.coalesce(reached["bad"], reached["at"]))
        return F.struct(state.alias("state"), (reached["at"] + 1).alias("at"), bad.alias("bad"))

    walked = grouped.select(
        "id",
        F.flatten(F.transform("said", lambda t: _segments(template, t))).alias("segments"),
        F.aggregate("said", begin, walk).alias("end"),
    )
    return walked.select(
        F.col("id").alias(id),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("end.state").alias("state"),
        F.col("end.bad").isNull().alias("valid"),
        F.col("end.state").isin(*template.ends).alias("complete"),
        F.col("end.bad").alias("first_bad_turn"),
    )


def read_turns(formatted: Column, template: Template = INSTRUCTIONS) -> Column:
    """The turns of a formatted conversation, array of struct(role, text), read from its marks."""
    raw = F.regexp_extract_all(formatted, F.lit(template.turn_pattern()), F.lit(0))

    def read(turn: Column) -> Column:
        def inner(before: Column | int, after: str) -> Column:
            size = F.length(turn) - len(after)
            return template.unescape(F.substring(turn, before + 1, size - before))

        def said(role: Column, text: Column) -> Column:
            return F.struct(role.alias("role"), text.alias("text"))

        named, begun, end = template.other
        cut = F.locate(begun, turn) - 1
        other = said(
            template.unescape(F.substring(turn, F.lit(len(named) + 1), cut - len(named))),
            inner(cut + len(begun), end),
        )
        found = F.when(turn.startswith(named), other)
        for role, marks in sorted(template.turns.items(), key=lambda x: x[1].before == ""):
            own = said(F.lit(role), inner(F.lit(len(marks.before)), marks.after))
            found = found.when(turn.startswith(marks.before), own)
        return found

    return F.transform(raw, read)


def loss_text(segments: Column, template: Template = INSTRUCTIONS) -> Column:
    """All text under the loss mask, as it was before the escapes."""
    counted = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(counted, lambda s: template.unescape(s["text"])), "")
