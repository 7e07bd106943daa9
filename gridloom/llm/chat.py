"""Chat formatting by a finite-state machine over roles, in DataFrame operations only.

A ``Template`` says in data how a turn is marked, which roles may follow which, and which roles are learnt from. A conversation
becomes a list of segments (text, loss), whose texts one after the other are the formatted conversation; the loss flag is set on
the texts of learnt roles alone, never on marks. Control strings inside texts are escaped, so that none of them stands in a segment but as a
mark, and reading back gives the very texts.

Escaping puts one more backslash behind the first character of a control string and whatever backslashes stand there already: ``</s>``
becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``. Taking one away is its inverse, as every such place in an escaped text has at least one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import filled

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How conversations are written.

    A turn is ``opening``, the role, ``between``, the text, ``closing``. ``turns`` maps each state of the machine to the roles it takes and the states
    they lead to; it begins in ``start`` and may end in a state of ``ends``. ``controls`` are further strings that texts must not hold raw.
    """

    opening: str = "<|im_start|>"
    between: str = "\n"
    closing: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "start"
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        firsts = {c[:1] for c in self.forbidden}
        if any(len(c) < 2 for c in self.forbidden):
            raise ValueError("a control string has two characters or more")
        if ESCAPE in firsts or any(ESCAPE in c or any(x in firsts for x in c[1:]) for c in self.forbidden):
            raise ValueError("a control string holds a backslash, or what another begins with behind its first character")
        if not self.between or any(x in "".join(self.forbidden) for x in self.between):
            raise ValueError("what stands between role and text must share no character with a control string")
        if not any(self.closing.startswith(c) for c in self.forbidden) or not any(self.opening.startswith(c) for c in self.forbidden):
            raise ValueError("marks must begin with a control string")

    @property
    def forbidden(self) -> tuple[str, ...]:
        """All control strings, the marks' own among them."""
        marks = (m.strip("\n") for m in (self.opening, self.closing))
        return tuple(dict.fromkeys((*marks, *self.controls)))

    def patterns(self) -> list[tuple[str, str]]:
        """(first character, the rest of its control strings), as parts of patterns that any engine reads alike."""
        out: dict[str, list[str]] = {}
        for c in self.forbidden:
            out.setdefault(c[0], []).append(_quoted(c[1:]))
        return [(_quoted(first), f"(?:{'|'.join(rest)})") for first, rest in out.items()]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\n ])", r"\\\1", text)


def escaped(text: Column, template: Template) -> Column:
    """``text`` without raw control strings."""
    for first, rest in template.patterns():
        text = F.regexp_replace(text, F.lit(rf"({first})(\\*{rest})"), F.lit(r"$1\\$2"))
    return text


def unescaped(text: Column, template: Template) -> Column:
    """What ``escaped`` was given."""
    for first, rest in template.patterns():
        text = F.regexp_replace(text, F.lit(rf"({first})\\(\\*{rest})"), F.lit("$1$2"))
    return text


def _said_role(role: Column) -> Column:
    """A role as it is written: letters of roles in use as they are, anything that could be taken for a mark or a line's end as %XX."""
    return F.url_encode(role)


def _checked(roles: Column, template: Template) -> Column:
    """The machine's end as (state, turn, bad): its last state, the number of turns, and the place of the first turn that it refuses, from 0."""
    moves = F.create_map(*[x for state, takes in template.turns.items() for role, to in takes.items() for x in (F.lit(f"{state}\t{role}"), F.lit(to))])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("bad"))

    def take(at: Column, role: Column) -> Column:
        to = F.when(at["bad"].isNull(), F.try_element_at(moves, F.concat(at["state"], F.lit("\t"), role)))
        return F.struct(F.coalesce(to, at["state"]).alias("state"), (at["turn"] + 1).alias("turn"), F.coalesce(at["bad"], F.when(to.isNull(), at["turn"])).alias("bad"))

    return F.aggregate(roles, begin, take)


def format_chats(rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: its id, n_turns, segments (text, loss), valid, bad_turn.

    Turns are in order of ``turn``, null first; turns of one number in order of role and text, repeats included. Null texts and
    roles are empty; rows of a null id are one conversation. ``bad_turn`` is the place, from 0, of the first turn that the machine refuses; a conversation
    that is cut off before an end is not valid and has none. Conversations that are not valid are formatted too, for the caller to keep or drop.
    An empty table gives an empty result; other columns, clashing names included, are not looked at.

    A conversation is one training example and one row, so its text has the bound of a Spark string, 2 GB. Rows are shuffled once, by
    conversation; no other order or place of them matters.
    """
    read = rows.select(F.col(conv_col).alias("_id"), F.struct(F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text")).alias("_row"))
    whole = read.groupBy("_id").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def turn(row: Column) -> Column:
        head = F.concat(F.lit(template.opening), _said_role(row["role"]), F.lit(template.between))
        return F.array(segment(head, F.lit(False)), segment(escaped(row["text"], template), row["role"].isin(*template.learnt)), segment(F.lit(template.closing), F.lit(False)))

    made = whole.select(
        "_id",
        F.size("_rows").cast("long").alias("n_turns"),
        F.flatten(F.transform("_rows", turn)).alias("segments"),
        _checked(F.transform("_rows", lambda r: r["role"]), template).alias("_end"),
    )
    valid = F.col("_end.bad").isNull() & F.col("_end.state").isin(*template.ends)
    return made.select(F.col("_id").alias(conv_col), "n_turns", "segments", valid.alias("valid"), F.col("_end.bad").alias("bad_turn"))


def formatted(segments: Column) -> Column:
    """A conversation as one string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learnt_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def read_turns(text: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, from its marks."""
    # What follows the last closing mark is empty, and no turn.
    pieces = F.split(text, _quoted(template.closing))
    opened = F.filter(pieces, lambda p: p.startswith(template.opening))

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(template.opening) + 1))
        cut = F.instr(inner, template.between)
        return F.struct(F.url_decode(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(inner, cut + len(template.between)), template).alias("text"))

    return F.transform(opened, turn)


#: A conversation whose texts are nothing but control strings; the query formats it beside the table's.
PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def chat_formatting(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """``format_chats`` of a conversations table and of conversation -7, and digests of what is read back from the formatted text and its segments.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars, loss_sha256 (of all text under the loss mask), formatted_chars,
    valid, bad_turn.
    """
    role = F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    probe = rows.sparkSession.range(0, 2, 1, 1).select(F.lit(PROBE_ID).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    out = format_chats(rows.select("conv_id", "turn", "role", "text").unionByName(probe), template)
    text = F.col("_text")
    read = out.select("conv_id", "valid", "bad_turn", formatted(F.col("segments")).alias("_text"), learnt_text(F.col("segments"), template).alias("_learnt"))
    turns = read.withColumn("_turns", read_turns(text, template))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"),
        F.char_length(text).cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
