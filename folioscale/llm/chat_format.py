"""Conversations as training texts, with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of the same role become one block with all their texts. A block is a list of
segments, each a text and whether the loss counts it; the training text is their concatenation:

    <s> [SYS] text [/SYS] [INST] text [+] text [/INST] [OUT] text </s> [AS] role [TEXT] text [/AS]

Marks stand between single spaces and hold none. A mark inside a text or a role name gets one backslash more than it has before it, so a space before a mark
is always ours, and texts with marks of their own are read back as they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing mark of a role; other roles are named between ``OTHER`` marks.
BLOCKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
START, OTHER, NAMED, JOINED = "<s>", ("[AS]", "[/AS]"), "[TEXT]", "[+]"
#: Of this role the loss counts the texts.
LEARNED = "assistant"

_OPENING = [*(a for a, _ in BLOCKS.values()), OTHER[0]]
_MARKS = [START, *(m for pair in BLOCKS.values() for m in pair), *OTHER, NAMED, JOINED]


def _any(marks: list[str]) -> str:
    return "(?:" + "|".join("\\" + m[:-1].replace("+", "\\+") + "\\" + m[-1] for m in marks) + ")"


def escaped(text: Column) -> Column:
    """One backslash before every mark in a text."""
    return F.regexp_replace(text, f"({_any(_MARKS)})", "\\\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"\\\\({_any(_MARKS)})", "$1")


def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def merged(turns: Column) -> Column:
    """Blocks of neighbouring turns with the same role, as structs of role and texts. Every turn is copied once."""
    first = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))

    def blocks(starts: Column) -> Column:
        def block(start: Column, k: Column) -> Column:
            end = F.when(k + 1 < F.size(starts), starts[F.least(k + 1, F.size(starts) - 1)]).otherwise(F.size(turns))
            return F.struct(turns[start]["role"].alias("role"), F.transform(F.slice(turns, start + 1, end - start), lambda t: t["text"]).alias("texts"))

        return F.transform(starts, block)

    return bound(first, blocks)


def segments(blocks: Column) -> Column:
    """Structs of ``text`` and ``loss`` whose texts follow one another without anything between."""
    mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
    known = lambda b, marks, other: reduce(lambda c, role: c.when(b["role"] == role, F.lit(marks(BLOCKS[role]))), BLOCKS, F).otherwise(other)

    def block(b: Column) -> Column:
        opening = known(b, lambda m: f" {m[0]} ", F.concat(F.lit(f" {OTHER[0]} "), escaped(b["role"]), F.lit(f" {NAMED} ")))
        closing = known(b, lambda m: f" {m[1]}", F.lit(f" {OTHER[1]}"))
        text = lambda t: F.struct(escaped(t).alias("text"), (b["role"] == LEARNED).alias("loss"))
        texts = F.flatten(F.transform(b["texts"], lambda t, k: F.array(mark(F.when(k == 0, opening).otherwise(F.lit(f" {JOINED} "))), text(t))))
        return F.concat(texts, F.array(mark(closing)))

    return F.concat(F.array(mark(F.lit(START))), F.flatten(F.transform(blocks, block)))


def text_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The id column, ``segments`` (structs of ``text`` and ``loss``) and ``formatted`` (their texts, joined) of each conversation.

    Turns go by ``turn_col``; of equal ones by role and then text, so the order of the rows never matters, and repeated rows are turns of their own. A null turn
    comes first. A null text or role is empty; an empty text is a turn like others. Rows with a null id are one conversation. Any role and any text can be
    read back with ``read_turns``. An empty table gives no rows. Other columns are left out, whatever their names.

    One shuffle by conversation, which is a row of the result: a conversation has to fit in one row (2 GB).
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.collect_list("t").alias("turns"))
    made = found.select("id", bound(F.array_sort("turns"), lambda turns: bound(merged(turns), segments)).alias("segments"))
    return made.select(F.col("id").alias(id_col), "segments", text_of(F.col("segments")).alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns of a training text, as structs of ``role`` and ``text``."""
    blocks = F.split(formatted, f"(?= {_any(_OPENING)} )", -1)

    def inner(block: Column, opening: int, closing: int) -> Column:
        return F.substring(block, F.lit(opening + 1), F.length(block) - opening - closing)

    def turns(block: Column) -> Column:
        texts = lambda role, joined: F.transform(F.split(joined, f" {_any([JOINED])} ", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))
        other = lambda b: texts(unescaped(F.substring_index(b, f" {NAMED} ", 1)), F.substring(b, F.length(F.substring_index(b, f" {NAMED} ", 1)) + len(NAMED) + 3, F.length(b)))
        out = reduce(lambda c, role: c.when(F.startswith(block, F.lit(f" {BLOCKS[role][0]} ")), texts(F.lit(role), inner(block, len(BLOCKS[role][0]) + 2, len(BLOCKS[role][1]) + 1))), BLOCKS, F)
        return out.otherwise(bound(inner(block, len(OTHER[0]) + 2, len(OTHER[1]) + 1), other))

    return F.flatten(F.transform(bound(blocks, lambda b: F.slice(b, F.lit(2), F.size(b) - 1)), turns))


def read_loss(parts: Column) -> Column:
    """The text that the loss counts, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
