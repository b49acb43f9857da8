"""Preference formatting, by DataFrame functions alone.

A pair is two lists of (role, text) turns.  The longest common prefix of turns is rendered
once, as the prompt; what is left of either side is rendered as its completion, with a mask:
the spans of characters to train on, which are the assistant's texts with their end marks.

A null role is "unknown", a null text is empty, turns are in order of turn number (null
first; equal numbers by role and text).  Marks inside texts are broken by a blank so that a text can't end
its own turn.  Equal sides leave both completions empty; an empty side has an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import with_next

START, END = "<|im_start|>", "<|im_end|>"  # fixed values of the ChatML format
ASSISTANT = "assistant"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (role, text)."""
    clean = conversations.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    listed = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turn: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(START), safe(turn["role"]), F.lit("\n"), safe(turn["text"]), F.lit(END + "\n"))


def render(part: Column) -> Column:
    return F.array_join(F.transform(part, _rendered), "")


def mask(part: Column) -> Column:
    """Spans [start, end) of the rendered part to train on, as "start-end start-end"."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        size = F.length(_rendered(turn))
        head = F.length(F.replace(turn["role"], F.lit("<|"), F.lit("< |"))) + len(START) + 1
        span = F.concat((acc["at"] + head).cast("string"), F.lit("-"), (acc["at"] + size - 1).cast("string"))
        spans = F.when(turn["role"] == ASSISTANT, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + size).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(part, zero, step)["spans"], " ")


def common_turns(a: Column, b: Column) -> Column:
    """Turns of the longest common prefix."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.get(a, k - 1) != F.get(b, k - 1))
    return F.coalesce(F.array_min(differ) - 1, n)


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds n_common, prompt, chosen_text, chosen_mask, rejected_text and rejected_mask."""
    with_n = pairs.withColumn("n_common", common_turns(F.col(chosen), F.col(rejected)))
    rest = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    return with_n.withColumns({
        "prompt": render(F.slice(F.col(chosen), F.lit(1), F.col("n_common"))),
        "chosen_text": render(rest(chosen)), "chosen_mask": mask(rest(chosen)),
        "rejected_text": render(rest(rejected)), "rejected_mask": mask(rest(rejected)),
    })


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for every conversation: as it is, and with its last assistant turn answered by
    the last assistant turn of the next conversation by conv_id (the text "" if that has
    none).  A conversation without an assistant turn gets the foreign answer at its end."""
    texts = F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"])
    own = turns(conversations).withColumn("answer", F.coalesce(F.element_at(F.when(F.size(texts) > 0, texts), -1), F.lit("")))
    near = with_next(own, "conv_id", [], ["conv_id", "answer"])
    last = F.coalesce(F.array_max(F.filter(F.transform("turns", lambda t, k: F.when(t["role"] == ASSISTANT, k)), lambda k: k.isNotNull())), F.size("turns"))
    foreign = F.struct(F.lit(ASSISTANT).alias("role"), F.col("next_row.answer").alias("text"))
    after = F.slice(F.col("turns"), F.col("last") + 2, F.size("turns"))
    rejected = F.concat(F.slice(F.col("turns"), F.lit(1), F.col("last")), F.array(foreign), after)
    return near.withColumn("last", last).select("conv_id", F.col("next_row.conv_id").alias("rejected_conv_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))
