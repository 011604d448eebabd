"""Preference formatting: the longest common turn prefix once as prompt, then paired completions with loss masks.

All at the level of turns, with built-in functions: the two conversations of a
pair meet in one join on (pair, turn), the first turn in which they differ is a
minimum that combines before the shuffle, and every turn is rendered where it
stands. No conversation is gathered into one row, so a pair of any length works.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"  # the template: begin role middle text end


def _turns(side: DataFrame, mark: str) -> DataFrame:
    """One row per (pair_id, turn): the smallest (role, text) of repeated rows; NULL role and text count as empty."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (side.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
            .groupBy("pair_id", "turn").agg(F.min(said).alias(mark)))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, trained_role="assistant") -> DataFrame:
    """(pair_id, part, turn, role, rendered, trained): the turns of every pair, formatted.

    `chosen` and `rejected` hold (pair_id, turn, role, text). part is `prompt` for
    the turns before the first difference, given once; from there on the turns of
    either side are `chosen` and `rejected`. Concatenating a part's `rendered` in
    the order of `turn` gives its text; `trained` marks the turns that carry loss
    (the trained role's turns of the completions), all others are masked.

    Turns compare by role and text. A turn that only one side has is a
    difference. Equal conversations are all prompt; a pair that lacks one side is
    all completion. Rows with a NULL pair_id or turn take no part; of repeated
    turns the smallest (role, text) counts; NULL role and text count as empty.
    Other columns are ignored. Empty tables give no rows.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), ["pair_id", "turn"], "full")
    cut = both.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("cut"))
    placed = both.join(cut, "pair_id", "left")
    shared = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    sides = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("said")))).otherwise(F.filter(F.array(
        F.struct(F.lit("chosen").alias("part"), F.col("c").alias("said")),
        F.struct(F.lit("rejected").alias("part"), F.col("r").alias("said"))), lambda x: x["said"].isNotNull()))
    rows = placed.select("pair_id", "turn", F.inline(sides))
    return rows.select("pair_id", "part", "turn", F.col("said.role").alias("role"),
                       F.concat(F.lit(BEGIN), "said.role", F.lit(MIDDLE), "said.text", F.lit(END)).alias("rendered"),
                       ((F.col("part") != "prompt") & (F.col("said.role") == trained_role)).alias("trained"))


def swapped_replies(conversations: DataFrame):
    """(chosen, rejected) from plain conversations: each loses its last assistant turn to that of its neighbour's.

    Conversations 2k and 2k + 1 are neighbours. Where the neighbour is missing or
    has no assistant turn, the turn is left out; a conversation without an assistant turn stays as it is.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = (turns.where(F.col("role") == "assistant").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("reply"))
            .select("pair_id", "reply"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply.text").alias("other"),
                        F.lit(True).alias("has_other"))
    replies = last.join(other, "pair_id", "left").select("pair_id", F.col("reply.turn").alias("at"), "other", "has_other")
    rejected = (turns.join(replies, "pair_id", "left")
                .where(F.col("at").isNull() | (F.col("turn") != F.col("at")) | F.coalesce("has_other", F.lit(False)))
                .withColumn("text", F.when(F.col("turn") == F.col("at"), F.col("other")).otherwise(F.col("text"))))
    return turns, rejected.select("pair_id", "turn", "role", "text")
