"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

Everything is a DataFrame expression. The machine's state is the role last seen, so a turn is in order exactly if its
role may follow the role before it. Each turn becomes the segments its template lists, and every segment carries
whether it is trained on. Control strings inside a text are escaped, so a formatted conversation can be read back.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

_BACKSLASH = "\\"


@dataclass(frozen=True)
class Template:
    """Marks around turns, roles that may follow each other, and the roles whose text is trained on.

    ``opening`` is what every mark begins with; it never occurs in escaped text. ``start`` is the state before the
    first turn.
    """

    opening: str = "<|"
    turn_start: str = "<|im_start|>"
    after_role: str = "\n"
    turn_end: str = "<|im_end|>"
    after_turn: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user", "tool"),
        "tool": ("assistant",),
    })


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    """Double the escape sign, and part the opening of a mark by one."""
    first, rest = template.opening[0], template.opening[1:]
    return F.replace(F.replace(text, F.lit(_BACKSLASH), F.lit(_BACKSLASH * 2)),
                     F.lit(template.opening), F.lit(first + _BACKSLASH + rest))


def unescape(text: Column, template: Template = CHAT) -> Column:
    """Undo ``escape``: between doubled signs, a single one is dropped."""
    first, rest = template.opening[0], template.opening[1:]
    pieces = F.split(text, r"\\\\")
    return F.array_join(F.transform(pieces, lambda p: F.replace(
        p, F.lit(first + _BACKSLASH + rest), F.lit(template.opening))), _BACKSLASH)


def _escape_role(role: Column, template: Template) -> Column:
    """A role is one line: a line feed in it becomes an escape of its own."""
    return F.replace(escape(role, template), F.lit(template.after_role), F.lit(_BACKSLASH + "n"))


def _unescape_role(role: Column, template: Template) -> Column:
    first, rest = template.opening[0], template.opening[1:]
    pieces = F.split(role, r"\\\\")
    return F.array_join(F.transform(pieces, lambda p: F.replace(
        F.replace(p, F.lit(_BACKSLASH + "n"), F.lit(template.after_role)),
        F.lit(first + _BACKSLASH + rest), F.lit(template.opening))), _BACKSLASH)


def _may_follow(state: Column, role: Column, template: Template) -> Column:
    allowed = F.lit(False)
    for before, after in template.follows.items():
        allowed = F.when(state == before, role.isin(*after)).otherwise(allowed)
    return allowed


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: ``conv_id``, ``in_order``, ``first_fault``, ``segments``, ``formatted``.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Rows are put in order of turn, equal turns by
    role and text, a null turn first. A null role or text counts as empty, rows without a conv_id are one
    conversation. ``segments`` lists (text, loss) in order, and ``formatted`` is their texts joined. ``first_fault``
    is the place, from 0, of the first turn whose role may not follow; a conversation out of order is formatted all
    the same. A conversation is one record, so its turns meet in one task.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("turn"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    states = F.concat(F.array(F.lit(template.start)), roles)
    faults = F.filter(
        F.transform(roles, lambda role, at: F.when(~_may_follow(F.get(states, at), role, template), at)),
        lambda at: at.isNotNull())

    def segments(turn: Column) -> Column:
        trained = turn["role"].isin(*template.trained)
        parts = (
            (F.concat(F.lit(template.turn_start), _escape_role(turn["role"], template), F.lit(template.after_role)),
             F.lit(False)),
            (escape(turn["text"], template), trained),
            (F.lit(template.turn_end + template.after_turn), F.lit(False)),
        )
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    return chats.select(
        "conv_id", (F.size(faults) == 0).alias("in_order"), F.get(faults, F.lit(0)).cast("int").alias("first_fault"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: str | Column = "formatted", template: Template = CHAT) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    column = F.col(formatted) if isinstance(formatted, str) else formatted
    # What stands before the first mark is nothing; a turn ends at its closing mark.
    turns = F.slice(F.split(column, _quoted(template.turn_start)), 2, F.lit(1 << 30))

    def turn(chunk: Column) -> Column:
        head = F.instr(chunk, F.lit(template.after_role))
        body = F.substr(chunk, head + F.lit(len(template.after_role)))
        return F.struct(
            _unescape_role(F.substr(chunk, F.lit(1), head - 1), template).alias("role"),
            unescape(F.substring_index(body, template.turn_end, 1), template).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: str | Column = "segments", template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped, with nothing between the parts."""
    column = F.col(segments) if isinstance(segments, str) else segments
    return F.array_join(F.transform(F.filter(column, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"], template)), "")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
