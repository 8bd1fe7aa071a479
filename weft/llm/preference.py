"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt, and what
follows becomes a pair of completions with loss masks.

A mask is the list of code point ranges of a completion that count for training: the text and end marker of the assistant's turns.
Nulls: a null role or text is rendered as empty and never trained on. Equal conversations have empty completions. Repeated turns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import with_next

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): a row per conversation, its turns by (turn, role, text). A conversation is one row of the result, so its turns meet in one task."""
    one = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return one.select(key, F.transform("t", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    m = F.least(F.size(a), F.size(b))
    at = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(at, lambda i: F.element_at(a, i) != F.element_at(b, i))) - 1, m)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def mask(turns: Column) -> Column:
    """Ranges (start, end) of the rendered turns that are the assistant's text and end marker."""
    head = lambda t: F.lit(len(START) + 1) + F.length(t["role"])
    size = lambda t: head(t) + F.length(t["text"]) + len(END) + 1

    def step(acc: Column, t: Column) -> Column:
        own = F.array(F.struct((acc["at"] + head(t)).alias("s"), (acc["at"] + size(t) - 1).alias("e")))
        return F.struct((acc["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.expr("struct(0 AS at, cast(array() AS array<struct<s:int,e:int>>) AS spans)"), step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """From columns chosen and rejected (arrays of (role, text)): keep, n_common, prompt, and text and mask of both completions."""
    p = pairs.select(*keep, "chosen", "rejected", common_turns(F.col("chosen"), F.col("rejected")).alias("n_common"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    p = p.select(*keep, "n_common", F.slice("chosen", 1, F.col("n_common")).alias("common"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return p.select(*keep, F.col("n_common").cast("long").alias("n_common"), render(F.col("common")).alias("prompt"), render(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), render(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chosen, rejected): every conversation, and the same with its last assistant turn's text replaced by that of the next
    conversation by conv_id (after the last: the first). If the next one has none, the turn is left out; without an own one both are equal."""
    c = conversations(turns)
    reply = F.element_at(F.filter("turns", lambda t: t["role"] == "assistant"), -1)
    nx = with_next(c.withColumn("reply", F.when(F.exists("turns", lambda t: t["role"] == "assistant"), reply["text"])), "conv_id", ["reply"], ["reply"], "nx")
    at = F.coalesce(F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1))), F.lit(0))
    nx = nx.withColumn("at", at)
    changed = F.filter(F.transform("turns", lambda t, i: F.when(i + 1 != F.col("at"), t).when(F.col("nx.reply").isNotNull(), F.struct(t["role"].alias("role"), F.col("nx.reply").alias("text")))), lambda t: t.isNotNull())
    return nx.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("turns").alias("chosen"), changed.alias("rejected"))
