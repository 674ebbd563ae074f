"""Chat formatting with a grammar round trip, in SQL functions only.

The template is, for each turn::

    <|im_start|>role
    text<|im_end|>

A conversation is rendered as it is and read back by the parser below. Where the turns
read back are not those of the source, because a text or role holds what the grammar
uses, its conflicting content is escaped and it is rendered and read back again, until
both are identical; one round of escaping is always enough, and more would raise.

Escaping puts a backslash after the ``<`` of each ``<|`` (and of ``<\\|``, ``<\\\\|``
and so on), which takes the control strings out of a text and is undone by taking one
backslash away. In roles line breaks and per cent signs are written ``%0A`` and ``%25``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lactoscope.llm.stages import stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, null role and text empty.

    Rows of one turn number are ordered by role and text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def rendered(turns: Column, escape: Column) -> Column:
    """The turns of a conversation under the template."""

    def one(t: Column) -> Column:
        role = F.when(escape, escaped_role(t.role)).otherwise(t.role)
        text = F.when(escape, escaped(t.text)).otherwise(t.text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))

    return F.array_join(F.transform(turns, one), "")


def parsed(text: Column) -> Column:
    """Turns read from a rendered conversation: ``role, raw, text``, null where the grammar breaks.

    Every start string opens a turn, whose role goes to the first line break and whose
    raw text goes to the first end string, after which only a line break may follow.
    """
    parts = F.slice(F.split(text, r"<\|im_start\|>"), 2, 1_000_000_000)

    def one(part: Column) -> Column:
        line, stop = F.instr(part, "\n"), F.instr(part, END)
        whole = (line > 0) & (stop > line) & (F.substring(part, stop, F.length(part)) == END + "\n")
        raw = F.substring(part, line + 1, stop - line - 1)
        role = F.substring(part, F.lit(1), line - 1)
        return F.when(whole, F.struct(unescaped_role(role).alias("role"), raw.alias("raw"), unescaped(raw).alias("text")))

    return F.transform(parts, one)


def _recovered(text: Column, turns: Column) -> Column:
    read = F.transform(parsed(text), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    return read.eqNullSafe(turns)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, escaped, formatted, mask``: one row for each conversation.

    ``mask`` lists the stretches of ``formatted`` that a model learns, the texts of the
    assistant's turns, as ``start`` and ``length`` in code points. Rows with a null
    ``conv_id`` are one conversation; a repeated row is a turn of its own.
    """
    plain = conversations_of(turns).withColumn("formatted", rendered(F.col("turns"), F.lit(False)))
    tried = plain.withColumn("escaped", ~_recovered(F.col("formatted"), F.col("turns")))
    again = F.when(F.col("escaped"), rendered(F.col("turns"), F.lit(True))).otherwise(F.col("formatted"))
    final = tried.withColumn("formatted", again)
    wrong = F.col("escaped") & ~_recovered(F.col("formatted"), F.col("turns"))
    checked = F.when(wrong, F.raise_error(F.lit("a conversation is not read back as it was"))).otherwise(F.col("formatted"))
    return final.select("conv_id", "escaped", checked.alias("formatted")).withColumn("mask", _mask(F.col("formatted")))


def _mask(text: Column) -> Column:
    """Start and length of the raw text of each assistant turn, from the parsed text."""
    parts = F.slice(F.split(text, r"<\|im_start\|>"), 2, 1_000_000_000)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        line, stop = F.instr(part, "\n"), F.instr(part, END)
        begin = state.at + len(START)
        span = F.struct((begin + line).cast("int").alias("start"), (stop - line - 1).cast("int").alias("length"))
        learned = F.substring(part, F.lit(1), line - 1) == LEARNED_ROLE
        found = F.when(learned, F.concat(state.found, F.array(span))).otherwise(state.found)
        return F.struct((begin + F.length(part)).cast("int").alias("at"), found.alias("found"))

    return F.aggregate(parts, first, step, lambda s: s.found)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back by the parser and the mask."""
    turns = parsed(F.col("formatted"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join(
        F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m.start + 1, m.length))), ""
    )
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def stored_digests(turns: DataFrame) -> DataFrame:
    """Format, write to the shared folder, read back and digest."""
    return digests(stored(format_conversations(turns)))
