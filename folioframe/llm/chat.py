r"""Conversations as one training text each, with a loss mask, in Spark expressions only.

A conversation is ``<s>``, its blocks and ``</s>``.  A block is ``[INST role]``, its texts and ``[/INST]``; adjacent turns of one
role share a block, with ``[+]`` between their texts.  Inside texts a backslash after the first character of whatever looks
like a mark (any number of backslashes included) makes it an ordinary string; reading takes that backslash away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import let

_MARK = r"(?=/?INST|/?s>|\+\])"
_TO_ESCAPE, _ESCAPED = rf"([\[<]\\*){_MARK}", rf"([\[<]\\*)\\{_MARK}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _TO_ESCAPE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _opening(role: Column) -> Column:
    """A null role is a mark without a blank; the characters that would end the mark are written as numbers."""
    named = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))
    return F.when(role.isNull(), F.lit("[INST]")).otherwise(F.concat(F.lit("[INST "), named, F.lit("]")))


def _role(block: Column) -> Column:
    named = F.regexp_extract(block, r"\A\[INST ([^\]]*)\]", 1)
    return F.when(~block.startswith("[INST]"), F.replace(F.replace(named, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%")))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, mask): one row per conversation.

    ``mask`` is the loss mask as runs in order: (chars, loss).  Runs add up to the text's code points; each text of ``loss_role``
    is one run with loss true.  Turns are ordered by turn, then role and text; a null turn comes first, a null text is
    empty, a null role is a role of its own, a null conversation id is a conversation.  Repeated rows are repeated turns.
    Other columns are left out, and an empty table gives an empty result.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    talks = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)
        starts = F.when(i == 0, F.concat(F.lit("<s>"), _opening(t["role"]))).when(t["role"].eqNullSafe(before["role"]), F.lit("[+]"))
        return F.struct(starts.otherwise(F.concat(F.lit("[/INST]"), _opening(t["role"]))).alias("marks"), escape(t["text"]).alias("body"),
                        t["role"].eqNullSafe(F.lit(loss_role)).alias("loss"))

    end = "[/INST]</s>"
    run = lambda n, loss: F.struct(n.cast("bigint").alias("chars"), loss.alias("loss"))
    runs = F.flatten(F.transform("pieces", lambda p: F.array(run(F.char_length(p["marks"]), F.lit(False)), run(F.char_length(p["body"]), p["loss"]))))
    return talks.select("conv", F.transform("turns", piece).alias("pieces")).select(
        "conv", F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["marks"], p["body"])), ""), F.lit(end)).alias("formatted"),
        F.concat(runs, F.array(run(F.lit(len(end)), F.lit(False)))).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds, in order."""
    inner = F.regexp_replace(formatted, r"(?s)\A<s>|\[/INST\]</s>\z", "")
    blocks = F.split(inner, r"\[/INST\](?=\[INST[ \]])")

    def turns(block: Column) -> Column:
        texts = F.split(F.regexp_replace(block, r"\A\[INST[^\]]*\]", ""), r"\[\+\]")
        return F.transform(texts, lambda t: F.struct(_role(block).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def text_under(formatted: Column, mask: Column) -> Column:
    """The texts of the mask's runs with loss, cut out of ``formatted`` by the runs' lengths and unescaped, one after another."""
    nothing = F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
    starts = F.aggregate(mask, nothing, lambda acc, r: F.struct((acc["at"] + r["chars"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    cut = lambda at: F.transform(mask, lambda r, i: F.when(r["loss"], unescape(F.substr(formatted, F.get(at, i).cast("int"), r["chars"].cast("int")))).otherwise(F.lit("")))
    return F.array_join(let(starts, cut), "")


def read_back(talks: DataFrame) -> DataFrame:
    """``talks`` (as formatted) with ``turns``, read from the marks, and ``loss_text``, all text under the mask, unescaped."""
    return talks.withColumns({"turns": read_turns(F.col("formatted")), "loss_text": text_under(F.col("formatted"), F.col("mask"))})
