"""Preference formatting: pairs of a chosen and a rejected conversation become a prompt and two masked completions.

The longest common prefix of turns (same role and text) of the two is rendered once, as the prompt; what follows in
each is its completion, with the spans, in characters, in which a model is trained: what the assistant says there and
the end of its turn. Only DataFrame functions are used. A conversation is one row, so its turns have to fit a row.

Nulls: a null role reads as `user`, a null text as the empty text; two nulls are equal. Turns are ordered by turn, then
role and text, nulls first. If one conversation is a prefix of the other, or both are equal, a completion is empty and
has no span. Repeated rows of a turn are repeated turns. No conversations: no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (conv_id, turn, role, text) of each conversation, in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first turns two lists of turns share."""
    least = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | (F.get(a, i) != F.get(b, i)))
    return F.element_at(differ, 1)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, piece), "")


def piece(t: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(CLOSE))


def spans(turns: Column) -> Column:
    """Start and end of what the assistant says, in the rendered text of these turns."""
    before, after = OPEN.split("{role}")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        low = acc["at"] + len(before) + F.length(t["role"]) + len(after)
        high = low + F.length(t["text"]) + len(CLOSE)
        found = F.when(t["role"] == "assistant", F.concat(acc["found"], F.array(F.struct(low.alias("start"), high.alias("end"))))).otherwise(acc["found"])
        return F.struct(high.alias("at"), found.alias("found"))

    return F.aggregate(turns, start, step, lambda acc: acc["found"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with arrays of turns `chosen` and `rejected` -> the other columns, n_prompt_turns, prompt, and for each side its
    completion and spans."""
    new = {"n_prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"}
    rest = [F.col(f"`{c}`") for c in pairs.columns if c.lower() not in new]
    empty = F.array().cast(pairs.schema["chosen"].dataType)
    cut = pairs.select(*rest, F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    cut = cut.withColumn("n_prompt_turns", common_prefix(F.col("chosen"), F.col("rejected")))
    tail = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.size(side) - F.col("n_prompt_turns"))
    return cut.select(
        *rest, "n_prompt_turns", rendered(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        rendered(tail(F.col("chosen"))).alias("chosen"), let(tail(F.col("chosen")), spans).alias("chosen_spans"), rendered(tail(F.col("rejected"))).alias("rejected"), let(tail(F.col("rejected")), spans).alias("rejected_spans"),
    )


def paired(turns: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation as chosen; as rejected, its turns but the last, and then the last
    turn of the next conversation of its block of ids (the first one's after the last)."""
    convs = conversations(turns).withColumn("block", F.floor(F.coalesce("conv_id", F.lit(-1)) / block))
    order = Window.partitionBy("block").orderBy("conv_id")
    last = F.element_at("turns", -1)
    other = F.coalesce(F.lead(last).over(order), F.first(last).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return convs.withColumn("other", other).select("conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", 1, F.size("turns") - 1), F.array("other")).alias("rejected"))
