"""Conversations as training strings, by Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of turns of one role become one message. A message is

    <|im_start|>ROLE
    TEXT<|im_next|>TEXT<|im_end|>

with a line end behind it and a mark between the texts that were merged, so that every turn can be read back. The output is a
list of segments whose texts, joined, are the formatted string; ``loss`` marks the segments to train on, one for each
text of an assistant.

A control string begins with ``<|``. Texts and roles never hold one: in them a backslash goes between ``<`` and ``|``, one more
where there are some already; a line end inside a role is written ``<n|``. Both steps can be undone.

One row is one conversation, as the output asks for; conversations do not meet in any task but by the hash of their id, and no
step is more than linear in the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
SEGMENTS = "array<struct<text:string,loss:boolean>>"


def escape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")).otherwise(text)


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, r"<(\\*n?)\|", r"<\\$1|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n|"), F.lit("\n")), r"<\\(\\*n?)\|", r"<$1|")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """``conv_id``, ``n_turns`` and ``segments`` of every conversation.

    * turns come in the order of ``turn``, without one last; equal ones by role, then text; repeated rows repeat.
    * a null text or role is empty; rows without id are one conversation of their own.
    * ``trained`` is compared as it is, case and white space included; an empty text of it is an empty segment.
    * an empty table gives an empty result; other columns are not read.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return sorted_turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _bind(F.col("turns"), lambda all_: _segments(all_, trained)).alias("segments"))


def _segments(turns: Column, trained: str) -> Column:
    """Segments of sorted turns: where runs of a role begin, the texts of each run, and what stands around them."""
    marked = F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i))
    begins = F.filter(marked, lambda i: i.isNotNull())

    def message(run: Column) -> Column:
        name = run[0]["role"]
        head, tail = F.concat(F.lit(START), escape_role(name), F.lit("\n")), F.lit(END + "\n")
        texts = F.transform(run, lambda t: escape(t["text"]))
        plain = F.array(F.struct(F.concat(head, F.array_join(texts, NEXT), tail).alias("text"), F.lit(False).alias("loss")))
        # The mark between two texts goes before the later one; the head goes before the first.
        pieces = F.transform(texts, lambda t, i: F.array(
            F.struct(F.when(i == 0, head).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("loss")),
            F.struct(t.alias("text"), F.lit(True).alias("loss")),
        ))
        closed = F.concat(F.flatten(pieces), F.array(F.struct(tail.alias("text"), F.lit(False).alias("loss"))))
        return F.when(name == trained, closed).otherwise(plain)

    def cut(begins: Column) -> Column:
        ends = lambda k: F.coalesce(F.get(begins, k + 1), F.size(turns))
        return F.flatten(F.transform(begins, lambda b, k: _bind(F.slice(turns, b + 1, ends(k) - b), message)))

    return _bind(begins, cut)


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """What the mask covers, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_turns(text: Column) -> Column:
    """The turns of a formatted string, ``array<struct<role,text>>``."""

    def turns_of(message: Column) -> Column:
        parts = F.split(message, "\n", 2)
        return _bind(parts, lambda p: _bind(unescape_role(p[0]), lambda name: F.transform(
            F.split(F.split(p[1], _quoted(END), 2)[0], _quoted(NEXT), -1), lambda t: F.struct(name.alias("role"), unescape(t).alias("text"))
        )))

    messages = F.split(text, _quoted(START), -1)
    return F.flatten(F.transform(F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0))), turns_of))


def digest(output: DataFrame) -> DataFrame:
    """What the formatted conversations say of themselves, read back from their segments."""
    whole = output.select("conv_id", F.col("segments").cast(SEGMENTS).alias("segments"), formatted(F.col("segments")).alias("text"))
    read = whole.select("conv_id", read_turns(F.col("text")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.char_length("text").alias("chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"),
    )
