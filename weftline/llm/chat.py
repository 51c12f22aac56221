r"""Operator 2: chat formatting, with Spark expressions only.

Turn structs are collected and sorted, adjacent turns of one role are merged, and the result is concatenated:

    <s> [INST]role[/INST]text[NEXT]text</s> [INST]role[/INST]text</s> ...     (without the spaces between)

A control string inside a role or text gets a backslash after its first character, and one more if it has some
already, so that it is text and can be restored: </s> becomes <\/s>, <\/s> becomes <\\/s>. [NEXT] keeps apart the texts
of merged turns, so the output can be read back turn by turn. The loss mask has one span per assistant block, in code
points within its block; control strings in a span are not under the loss.

Turns are collected in chunks of ``CHUNK`` turn numbers and merged there first, then chunks are merged, so that the
sorting and merging of a long conversation is spread over tasks. A conversation's output is one string, which bounds it.

Defined results: null role and text count as empty; null turns come first; equal turns are ordered by role, then text;
repeated rows are turns of their own; null ids are one conversation; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
BEGIN, OPEN, CLOSE, NEXT, END = "<s>", "[INST]", "[/INST]", "[NEXT]", "</s>"
#: First character of a control string, backslashes, and what makes it one.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|NEXT\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|NEXT\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge(blocks: Column) -> Column:
    """Join neighbours of one role in an array of (role, texts); linear in the array."""

    def joined(b: Column) -> Column:
        n = F.size(b)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(b, i)["role"] != F.get(b, F.greatest(i - 1, F.lit(0)))["role"]))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(b, at)["role"].alias("role"), F.flatten(F.transform(F.slice(b, at + 1, F.coalesce(F.get(s, k + 1), n) - at), lambda x: x["texts"])).alias("texts"))))

    return let(blocks, joined)


def blocks_of(turns: DataFrame) -> DataFrame:
    """conv_id and blocks: array of (role, texts), roles of neighbours differ. Takes conv_id, turn, role, text."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    chunks = clean.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(one.alias("b")).select("conv_id", "chunk", merge(F.col("b")).alias("b"))
    whole = chunks.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "b"))), lambda c: c["b"])).alias("b"))
    return whole.select("conv_id", merge(F.col("b")).alias("blocks"))


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans: array of (block, start, length) of ``loss_role``'s blocks."""
    safe = F.transform("blocks", lambda b: F.struct(escape(b["role"]).alias("role"), F.array_join(F.transform(b["texts"], escape), NEXT).alias("text"), (b["role"] == loss_role).alias("loss")))
    whole = conversations.select("conv_id", safe.alias("safe"))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("safe", lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(CLOSE), b["text"], F.lit(END))), ""))
    spans = F.transform("safe", lambda b, k: F.when(b["loss"], F.struct(k.alias("block"), (F.length(b["role"]) + len(OPEN) + len(CLOSE)).alias("start"), F.length(b["text"]).alias("length"))))
    return whole.select("conv_id", text.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Format conversations given by rows (conv_id, turn, role, text)."""
    return render(blocks_of(turns), loss_role)


def _raw_blocks(formatted: Column) -> Column:
    parts = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), END)
    return let(parts, lambda p: F.slice(p, 1, F.size(p) - 1))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) parsed from the string, and loss: the unescaped texts under the mask, in order."""
    cut = formatted.select("conv_id", "formatted", "loss_spans", _raw_blocks(F.col("formatted")).alias("raw"))

    def turns(block: Column) -> Column:
        return let(
            F.split(block, r"\[/INST\]", 2),
            lambda p: let(unescape(F.substring(F.get(p, F.lit(0)), len(OPEN) + 1, 2**31 - 1)), lambda role: F.transform(F.split(F.get(p, F.lit(1)), r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))),
        )

    loss = let(F.col("raw"), lambda raw: F.flatten(F.transform("loss_spans", lambda s: F.transform(F.split(F.substring(F.get(raw, s["block"]), s["start"] + 1, s["length"]), r"\[NEXT\]"), unescape))))
    return cut.select("conv_id", "formatted", F.flatten(F.transform("raw", turns)).alias("turns"), loss.alias("loss"), F.size("raw").alias("n_blocks"))


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    row = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.array_join("loss", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("n_blocks").cast("long").alias("n_blocks"))
    return row.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_blocks")
