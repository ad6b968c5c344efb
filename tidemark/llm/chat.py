"""Chat formatting with Spark expressions only.

Template: turns of one speaker that follow each other make one block, and a block is mark, texts with ``[SEAM]``
between, mark.  Inside texts and role names a control string gets a backslash after its first character (and one more
if it had some there), so no control string is left, and taking one away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Control strings begin with < or [ and hold neither again, so they cannot arise where a text meets a mark.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER, NAME_END, OTHER_END, SEAM = "[ROLE]", "[TEXT]", "[/ROLE]", "[SEAM]"
_INNER = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|SEAM\])"
CLOSE = r"\[/INST\]|</s>|\[/SYS\]|\[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(?=" + _INNER + ")", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(?=" + _INNER + ")", "$1$2")


def _by_role(role: Column, at: int, other: Column) -> Column:
    out = other
    for name, marks in MARKS.items():
        out = F.when(role == name, marks[at]).otherwise(out)
    return out


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``segments`` (array of text, loss: formatted cut up in order).

    Loss is on the assistant's texts alone.  Rows count by turn (null first), then role, then text, so ties have a
    defined order and repeated rows all stay; a null text or role is empty; rows with a null conv are one conversation.
    A conversation becomes one row, so it has to fit Spark's 2 GB for a row.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), text_of(text).alias("text"))
    turns = df.select(F.col(conv).alias("conv"), row.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    # Where blocks begin; a block's turns are a slice, so the merge is linear in the turns.
    starts = F.filter(index, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    cut = turns.withColumn("starts", starts)
    blocks = F.transform("starts", lambda s, k: F.struct(F.get("turns", s)["role"].alias("role"), F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s)["text"].alias("texts")))
    parted = cut.select("conv", blocks.alias("blocks"))

    def pieces(b: Column) -> Column:
        opening = _by_role(b["role"], 0, F.concat(F.lit(OTHER), escape(b["role"]), F.lit(NAME_END)))
        closing = _by_role(b["role"], 1, F.lit(OTHER_END))
        mark = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        body = F.flatten(F.transform(b["texts"], lambda t, i: F.array(mark(F.when(i == 0, opening).otherwise(SEAM)), F.struct(escape(t).alias("text"), (b["role"] == "assistant").alias("loss")))))
        return F.concat(body, F.array(mark(closing)))

    segments = parted.select(F.col("conv").alias(conv), F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return segments.select(conv, F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text): the turns that a formatted conversation was made of."""
    whole = F.split(formatted, CLOSE, -1)
    blocks = F.filter(F.slice(whole, 1, F.size(whole) - 1), lambda b: F.lit(True))
    other_role = lambda b: unescape(F.regexp_extract(b, r"(?s)\A\[ROLE\](.*?)\[TEXT\]", 1))

    def opened(b: Column) -> Column:
        role, body = other_role(b), F.regexp_replace(b, r"(?s)\A\[ROLE\].*?\[TEXT\]", "")
        for name, (mark, _) in MARKS.items():
            role, body = F.when(b.startswith(mark), name).otherwise(role), F.when(b.startswith(mark), F.substr(b, F.lit(len(mark) + 1))).otherwise(body)
        return F.transform(F.split(body, r"\[SEAM\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, opened))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
