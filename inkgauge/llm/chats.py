"""Preference formatting of pairs of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once as
the prompt; what follows in each is a completion, with the spans that a loss may count. Marks
inside roles and texts are escaped, so different turns never render alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.columns import let
from inkgauge.llm.common import take

START, END = "<|{}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def escaped(role: Column, text: Column) -> tuple[Column, Column]:
    """Role and text in which no mark begins or ends.

    Between '<' and '|' of a text, and '|' and '>' of a role, a backslash more than there was is
    put, so taking one away again gives the original.
    """
    return F.regexp_replace(role, r"\|(\\*)>", r"|\\$1>"), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(role: Column, text: Column) -> tuple[Column, Column]:
    """What `escaped` was given."""
    return F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"), F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def render(turns: Column) -> Column:
    """Escaped turns as one string: '<|role|>' on a line, the text, '<|end|>' on a line."""
    parts = F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END)))
    return F.array_join(parts, "")


def loss_spans(turns: Column, role: str = TRAINED_ROLE) -> Column:
    """array<struct<start, end>>: code points of the rendered turns that are trained on.

    Of a turn of `role` the text and its end mark count, of other turns nothing.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.char_length(t["role"]) + 5
        end = begin + F.char_length(t["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start that are equal in role and text."""
    pairs = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, F.greatest(F.least(F.size(a), F.size(b)), F.lit(0)))
    differs = F.transform(pairs, lambda p, i: F.when(~p["a"].eqNullSafe(p["b"]), i))
    return F.coalesce(F.array_min(differs), F.size(pairs))


def format_preferences(pairs: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """`pairs` has pair_id and two arrays of struct(role, text), chosen and rejected.

    Returns pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans. If one
    conversation is the start of the other, or both are equal, a completion is empty. Null turns
    or arrays count as empty, null roles and texts as empty strings. Spans count the code points of
    the escaped text, as it stands in the completion.
    """
    rows = take(pairs, "pair_id", "chosen", "rejected")

    def plain(turns: str) -> Column:
        def safe(t: Column) -> Column:
            who, what = escaped(F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit("")))
            return F.struct(who.alias("role"), what.alias("text"))

        clean = F.transform(F.filter(turns, lambda t: t.isNotNull()), safe)
        return F.coalesce(clean, F.array().cast(TURNS))

    rows = rows.select("pair_id", plain("chosen").alias("c"), plain("rejected").alias("r"))
    rows = rows.withColumn("n_common", common_turns(F.col("c"), F.col("r")))

    def after(turns: str) -> Column:
        rest = F.size(turns) - F.col("n_common")
        return F.slice(turns, F.col("n_common") + 1, rest)

    return rows.select(
        "pair_id",
        "n_common",
        render(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        render(after("c")).alias("chosen"),
        render(after("r")).alias("rejected"),
        let(after("c"), lambda t: loss_spans(t, role)).alias("chosen_spans"),
        let(after("r"), lambda t: loss_spans(t, role)).alias("rejected_spans"),
    )


def swapped_replies(turns: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """Preference pairs from a table of turns (conv_id, turn, role, text).

    The chosen conversation is the whole one. The rejected one is the same up to its last turn of
    `role`, which is replaced by the last such turn of its partner; conversations 2i and 2i+1 are
    partners. A conversation without a partner or without such turns in either is its own rejected
    one, so every conversation has a row. Turns without a conversation are left out; order is by
    turn, then role and text. A conversation is one row, so it must fit into one.
    """
    rows = take(turns, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    at = F.array_max(F.transform("t", lambda t, i: F.when(t["role"] == role, i)))
    talks = talks.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("t"), at.alias("at"))
    reply = talks.where("at IS NOT NULL").select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.get("t", F.col("at")).alias("other")
    )
    both = talks.join(reply, "conv_id", "left")
    swapped = F.concat(F.slice("t", F.lit(1), F.col("at")), F.array("other"))
    rejected = F.when(F.col("at").isNotNull() & F.col("other").isNotNull(), swapped).otherwise(F.col("t"))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("t").alias("chosen"), rejected.alias("rejected"))
