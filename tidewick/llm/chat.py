"""Preference formatting with DataFrame operations only.

A pair is a chosen and a rejected conversation. The turns that both begin with are rendered once,
as the prompt; the rest of each is its completion. The result has a row for each rendered turn,
with the loss mask of its text, so a conversation of any length is spread like any other rows;
assemble() makes one row a pair of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The template around a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def preference_segments(conversations: DataFrame, pairs: DataFrame, *, trained_role: str = "assistant") -> DataFrame:
    """(pair_id, part, turn, role, rendered, text_from, text_to, loss) for pairs (pair_id, chosen, rejected) of conv_ids.

    part is prompt (rows of the chosen conversation, once), chosen or rejected. text_from and text_to delimit the turn's
    text and closing mark in `rendered` (code points), which has loss 1 in completions of the trained role, else 0.

    Turns go by number. Two turns match if number, role and text are equal (nulls equal nulls), and the prompt ends
    before the first number at which the two conversations differ or one of them lacks a turn that the other has.
    Where a number repeats in a conversation, the least (role, text) is kept; a null turn or conv_id is no turn.
    A null text renders as empty, a null role as "unknown". A conversation that a pair lacks (null or unknown id) has no
    turns: the prompt is empty and the other side all completion. Extra columns are ignored.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("int").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null and turn is not null")
    turns = turns.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("said"))
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("conv_id")))).alias("s")).select("pair_id", "s.side", "s.conv_id").where("conv_id is not null")
    said = sides.join(turns, "conv_id").select("pair_id", "side", "turn", "said")
    # Both sides of a turn meet in one group of two rows; a third of all rows in one pair is still many groups.
    met = said.groupBy("pair_id", "turn").agg(F.max(F.when(F.col("side") == "chosen", F.col("said"))).alias("chosen"), F.max(F.when(F.col("side") == "rejected", F.col("said"))).alias("rejected"))
    split = met.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("turn").alias("split"))
    rows = met.join(split, "pair_id", "left")
    shared = F.coalesce(F.col("turn") < F.col("split"), F.lit(True))
    part = lambda name, column: F.struct(F.lit(name).alias("part"), F.col(column).alias("said"))
    made = rows.select("pair_id", "turn", F.explode(F.when(shared, F.array(part("prompt", "chosen"))).otherwise(F.filter(F.array(part("chosen", "chosen"), part("rejected", "rejected")), lambda x: x["said"].isNotNull()))).alias("x"))
    role = F.coalesce(F.col("x.said.role"), F.lit("unknown"))
    text = F.coalesce(F.col("x.said.text"), F.lit(""))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    made = made.select("pair_id", F.col("x.part").alias("part"), "turn", role.alias("role"), F.concat(head, text, F.lit(CLOSE)).alias("rendered"), F.length(head).cast("long").alias("text_from"), (F.length(head) + F.length(text) + len(CLOSE)).cast("long").alias("text_to"))
    return made.withColumn("loss", ((F.col("part") != "prompt") & (F.col("role") == trained_role)).cast("int"))


def assemble(segments: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_loss, rejected_loss) from segments: one training example a row.

    The losses are lists of [from, to) spans, in code points, with loss 1 in the completion. A pair without a common
    prefix has an empty prompt, one that is all prefix two empty completions. An example must fit in a row.
    """
    w = Window.partitionBy("pair_id", "part").orderBy("turn")
    at = F.coalesce(F.sum(F.length("rendered")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = segments.withColumn("at", at).groupBy("pair_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "rendered", (F.col("at") + F.col("text_from")).alias("a"), (F.col("at") + F.col("text_to")).alias("b"), "loss"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: x["rendered"]), "")
    rows = rows.select("pair_id", "part", whole.alias("s"), F.transform(F.filter("t", lambda x: x["loss"] == 1), lambda x: F.array(x["a"], x["b"])).alias("l"))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    none = F.array().cast("array<array<bigint>>")
    return rows.groupBy("pair_id").agg(*(F.coalesce(pick(p, "s"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")), *(F.coalesce(pick(p, "l"), none).alias(f"{p}_loss") for p in ("chosen", "rejected")))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of conv_ids 2k (chosen) and 2k + 1 (rejected) with pair_id k, for every conversation that exists."""
    return conversations.where("conv_id is not null").select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen"), (F.col("pair_id") * 2 + 1).alias("rejected"))
