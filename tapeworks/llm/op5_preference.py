"""Preference formatting: a prompt from the longest common turn prefix of two conversations, and masked completions.

``sides`` has the turns of both conversations of each pair: pair_id, side (chosen or rejected), turn, role, text. The first turn at
which the sides differ, in role or text or because one has ended, splits them: the turns before it are rendered once, as the
prompt; those from there on are each side's completion. In completions only the assistant's words bear loss.

The result stays at one row for each rendered turn, so a conversation of any length is never gathered: the split is a
minimum over turns, found by combined aggregates. Sorted by part and turn and joined, a pair's rows are its three texts.

Rows without pair, side or turn are left out; a null role is ``unknown``, a null text empty; of rows that repeat a turn of a side
the least (by role, then text) stands. Sides that don't differ are all prompt. Pairs with one side only have no prompt. An
empty table gives an empty result; other columns are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _turns(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each turn."""
    known = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    said = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return known.groupBy(*keys).agg(F.min(said).alias("said")).select(*keys, "said.role", "said.text")


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def preferences(sides: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen or rejected), turn, role, rendered and loss_from (first character that bears loss; null: none)."""
    turns = _turns(sides.where("side IN ('chosen', 'rejected')").select("pair_id", "side", "turn", "role", "text"), "pair_id", "side", "turn")
    mark = F.sha2(F.concat(F.col("role"), F.lit("\n"), F.col("text")), 256)
    at = turns.groupBy("pair_id", "turn").agg(F.max(F.when(F.col("side") == "chosen", mark)).alias("c"), F.max(F.when(F.col("side") == "rejected", mark)).alias("r"))
    split = at.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("cut"))
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    out = turns.join(split, "pair_id").where(~common | (F.col("side") == "chosen"))
    head = header(F.col("role"))
    return out.select(
        "pair_id", F.when(common, "prompt").otherwise(F.col("side")).alias("part"), "turn", "role", F.concat(head, F.col("text"), F.lit(END)).alias("rendered"),
        F.when(~common & (F.col("role") == "assistant"), F.length(head).cast("long")).alias("loss_from"))


def stale_replies(conversations: DataFrame) -> DataFrame:
    """Sides for each conversation with two or more replies: up to its last reply, against the same with its first reply given again."""
    turns = _turns(conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    reply = F.when(F.col("role") == "assistant", F.col("turn"))
    ends = turns.groupBy("conv_id").agg(F.min(reply).alias("early"), F.max(reply).alias("late")).where("early < late")
    rows = turns.join(ends, "conv_id").where("turn <= late")
    pair = F.concat(F.lit("stale-"), F.col("conv_id").cast("string")).alias("pair_id")
    chosen = rows.select(pair, F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = rows.where("turn < late").select(pair, F.lit("rejected").alias("side"), F.explode(F.when(F.col("turn") == F.col("early"), F.array("turn", "late")).otherwise(F.array("turn"))).alias("turn"), "role", "text")
    return chosen.unionByName(rejected)


def same_openings(conversations: DataFrame) -> DataFrame:
    """Sides for conversations with equal first turns: each against the one with the smallest id; the one with more assistant text is chosen."""
    turns = _turns(conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    mark = F.sha2(F.concat(F.col("role"), F.lit("\n"), F.col("text")), 256)
    said = F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("said")
    each = turns.groupBy("conv_id").agg(F.min("turn").alias("first"), said)
    opening = turns.withColumnRenamed("turn", "first").join(each, ["conv_id", "first"]).select("conv_id", "said", mark.alias("opening"))
    heads = opening.groupBy("opening").agg(F.min("conv_id").alias("head"), F.count("*").alias("n"), F.min_by("said", "conv_id").alias("head_said")).where("n > 1")
    pairs = opening.join(heads, "opening").where("conv_id <> head")
    better = F.col("head_said") >= F.col("said")
    pairs = pairs.select(F.concat(F.lit("opening-"), F.col("conv_id").cast("string")).alias("pair_id"), F.when(better, F.col("head")).otherwise(F.col("conv_id")).alias("good"), F.when(better, F.col("conv_id")).otherwise(F.col("head")).alias("bad"))
    side = lambda column, name: pairs.select("pair_id", F.col(column).alias("conv_id")).join(turns, "conv_id").select("pair_id", F.lit(name).alias("side"), "turn", "role", "text")
    return side("good", "chosen").unionByName(side("bad", "rejected"))
