"""Chat formatting with Spark expressions: one string and one loss mask per conversation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the template.
START = "<|im_start|>"
SEPARATOR = "<|im_sep|>"
END = "<|im_end|>"
# Control strings of other templates, which texts may not carry either.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

TAILS = "|".join(re.escape(mark[1:]) for mark in (START, SEPARATOR, END, *FOREIGN))
PLAIN = rf"([<\[])(\\*)({TAILS})"
ESCAPED = rf"([<\[])\\(\\*)({TAILS})"


def escape(text: Column) -> Column:
    """One backslash more behind the first character of every control string, escaped ones
    included, so that no control string is left and ``unescape`` gives the text back."""
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned_role: str = "assistant",
) -> DataFrame:
    """``formatted`` and ``loss_mask`` of every conversation.

    Turns are sorted by turn, role and text, so ties and repeated rows have one order; a null
    turn comes first. Null roles and texts count as empty, rows with a null conversation form
    one conversation. Adjacent turns of one role share a block
    ``START role SEPARATOR text SEPARATOR text ... END``. ``loss_mask`` lists lengths in code
    points and whether they are learned: it covers the whole string, and marks each text of
    ``learned_role``. Other columns are not read. No rows give no rows. One conversation is one
    value, so its turns must fit into a cell (2 GB).
    """
    fields = (F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    collected = turns.groupBy(F.col(conversation).alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("turns")
    )
    clean = F.transform(
        "turns",
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("text"),
        ),
    )
    sorted_turns = collected.select("conv_id", clean.alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = F.filter(
        places,
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    cut = sorted_turns.select("conv_id", "turns", starts.alias("starts"))

    def run_of(start: Column, place: Column) -> Column:
        stop = F.coalesce(F.get("starts", place + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", start + 1, stop - start), lambda t: t["text"])
        return F.struct(F.get("turns", start)["role"].alias("role"), texts.alias("texts"))

    runs = cut.select("conv_id", F.transform("starts", run_of).alias("runs"))

    def block(run: Column) -> Column:
        head = F.concat(F.lit(START), escape(run["role"]), F.lit(SEPARATOR))
        return F.concat(head, F.array_join(run["texts"], SEPARATOR), F.lit(END))

    def masks(run: Column) -> Column:
        learned = run["role"] == learned_role
        head = F.lit(len(START) + len(SEPARATOR)) + F.char_length(escape(run["role"]))

        def parts(body: Column, place: Column) -> Column:
            before = F.when(place == 0, head).otherwise(F.lit(len(SEPARATOR)))
            return F.array(_length(before, F.lit(False)), _length(F.char_length(body), learned))

        tail = F.array(_length(F.lit(len(END)), F.lit(False)))
        return F.concat(F.flatten(F.transform(run["texts"], parts)), tail)

    return runs.select(
        "conv_id",
        F.array_join(F.transform("runs", block), "").alias("formatted"),
        F.flatten(F.transform("runs", masks)).alias("loss_mask"),
    )


def _length(chars: Column, learned: Column) -> Column:
    return F.struct(chars.cast("int").alias("chars"), learned.alias("learned"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """``turns`` (role and text) and ``learned`` (texts under the mask), read from the string."""
    blocks = F.split("formatted", re.escape(END))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns_of(block: Column) -> Column:
        parts = F.split(F.substring(block, len(START) + 1, 2**31 - 1), re.escape(SEPARATOR))
        texts = F.slice(parts, F.lit(2), F.size(parts) - 1)
        name = unescape(F.get(parts, F.lit(0)))
        return F.transform(
            texts, lambda t: F.struct(name.alias("role"), unescape(t).alias("text"))
        )

    def step(state: Column, part: Column) -> Column:
        found = F.array(unescape(F.substr(F.col("formatted"), state["at"], part["chars"])))
        return F.struct(
            (state["at"] + part["chars"]).alias("at"),
            F.when(part["learned"], F.concat(state["texts"], found))
            .otherwise(state["texts"])
            .alias("texts"),
        )

    nothing = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("texts"))
    return formatted.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.aggregate("loss_mask", nothing, step)["texts"].alias("learned"),
    )


def digests(read: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what was read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
