"""Preference formatting of conversations, in DataFrame functions only.

A pair's turns are compared from the first on; the longest common prefix (same role and text) is rendered once as the
prompt, what follows on either side is its completion, masked so that only assistant turns are trained on.

Turns are ordered by turn, then role, then text, nulls first; null roles and texts count as empty, so repeated turns stay.
A conversation that is missing on one side has an empty completion there. Turns without a conversation id are left out.
No turns give no pairs. A pair's turns are one row's arrays, so what a task holds grows with a conversation, not with the
table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is written around each turn.
HEAD_OPEN, HEAD_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD_OPEN), turn["role"], F.lit(HEAD_CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(TURN_END))


def render(turns: Column) -> Column:
    """All turns of an array as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def trained_spans(turns: Column) -> Column:
    """Spans (start, end) of a rendered array's characters that a model is trained on: assistant bodies with their end."""
    none = F.array().cast("array<struct<start:long,end:long>>")

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(_body(turn))
        own = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(turn["role"] == TRAINED_ROLE, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def preferences(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """turns(conv_id, turn, role, text) to one row per pair. pair: its key; chosen: true on the preferred side's turns.

    Both sides of a pair meet in the one shuffle that gathers its turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter("conv_id IS NOT NULL").select(pair.alias("pair_id"), "conv_id", chosen.alias("side"), turn.alias("item"))
    of = {side: F.when(F.col("side") if side == "chosen" else ~F.col("side"), F.col("item")) for side in ("chosen", "rejected")}
    ids = {side: F.when(F.col("side") if side == "chosen" else ~F.col("side"), F.col("conv_id")) for side in of}
    sides = rows.groupBy("pair_id").agg(
        *(F.min(ids[s]).alias(f"{s}_id") for s in of), *(F.sort_array(F.collect_list(of[s])).alias(s) for s in of)
    )
    sides = sides.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {s: F.slice(s, F.col("n_prompt_turns") + 1, F.greatest(F.size(s) - F.col("n_prompt_turns"), F.lit(0))) for s in of}
    sides = sides.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", F.slice("chosen", F.lit(1), F.col("n_prompt_turns")).alias("p"), *(rest[s].alias(s) for s in of)
    )
    return sides.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", render(F.col("p")).alias("prompt"),
        *(render(F.col(s)).alias(s) for s in of), *(trained_spans(F.col(s)).alias(f"{s}_trained") for s in of),
    )
