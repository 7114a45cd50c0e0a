"""Preference formatting.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role and text
equal, turn by turn) is rendered once, as the prompt; the turns behind it are rendered as the two
completions. Masks give the spans of a completion that are trained on: what assistant turns say, with
their end mark. Everything is one window and one aggregation per pair over turns aligned by (pair, turn), so two
long conversations are never compared by a join of all their turns, and rendering is linear in their length.

Defined cases: a null text or role counts as empty; turns without a conversation id or number are left
out; of several rows of one conversation with the same turn, the smallest (role, text) counts, so
repeated rows are harmless; a pair with only one side has an empty prompt and one empty completion; equal
sides give a prompt and two empty completions; long conversations and texts are rendered whole; an empty table
gives an empty result; other columns are ignored and never collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloq.session import cut

END = "<|end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; one row per turn."""
    said = F.struct(F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    one = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(said).alias("said"))
    return one.select("conv_id", "turn", "said.role", "said.text")


def _next_conversations(ids: DataFrame) -> DataFrame:
    """(conv_id, donor): the next id, around the end of the table.

    Ids are sorted into ranges; the last one of a range takes the first of the next range.
    """
    placed = cut(ids.repartitionByRange("conv_id").select("conv_id", "n", F.spark_partition_id().alias("range")))
    heads = placed.groupBy("range").agg(F.min("conv_id").alias("head"))
    around = Window.orderBy("head")  # one row per range
    heads = heads.select("range", F.coalesce(F.lead("head").over(around), F.first("head").over(around)).alias("after"))
    within = F.lead("conv_id").over(Window.partitionBy("range").orderBy("conv_id"))
    return placed.withColumn("next", within).join(F.broadcast(heads), "range").select("conv_id", "n", F.coalesce("next", "after").alias("donor"))


def crossed(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: each conversation is chosen; rejected is the same up to a turn of it, and
    from there on what the next conversation by conv_id (around the end of the table) has.

    The turn is the one at place ``(7 * conv_id + 3) mod n`` of the conversation's n turns, so sides part at their starts,
    in their middles or at their ends, in text, role or length, and where the other says the same, later or never. A
    table of one conversation makes a pair of equal sides. Gives (pair_id, side, turn, role, text).
    """
    turns = cut(_turns(conversations))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    rings = _next_conversations(sizes)
    at = F.pmod(F.pmod(F.col("conv_id"), F.col("n")) * 7 + 3, F.col("n"))
    parts = turns.withColumn("place", place).join(rings, "conv_id").where(F.col("place") == at).select("conv_id", "donor", F.col("turn").alias("from"))
    parts = cut(parts)
    own = turns.join(parts, "conv_id").select(F.col("conv_id").alias("pair_id"), (F.col("turn") < F.col("from")).alias("shared"), "turn", "role", "text")
    sides = F.when(F.col("shared"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    lent = turns.withColumnRenamed("conv_id", "donor").join(parts, "donor").where(F.col("turn") >= F.col("from"))
    rejected = lent.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    return own.select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text").unionByName(rejected)


def paired(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs from a preference table ``pairs(pair_id, chosen_id, rejected_id)``: (pair_id, side, turn, role, text).

    Turns are counted anew from 0 within each conversation, so sides meet by their places, however either is numbered.
    """
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id")))
    wanted = pairs.select("pair_id", F.explode(sides).alias("s")).select("pair_id", "s.side", "s.conv_id")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return wanted.join(_turns(conversations).withColumn("turn", place), "conv_id").select("pair_id", "side", "turn", "role", "text")


def format_preferences(sides: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected and their masks (spans as start:stop, joined by commas); one row per pair."""
    said = F.struct("role", "text")
    aligned = sides.where("pair_id is not null and turn is not null").groupBy("pair_id", "turn").agg(
        F.min(F.when(F.col("side") == "chosen", said)).alias("chosen"), F.min(F.when(F.col("side") == "rejected", said)).alias("rejected")
    )
    before = Window.partitionBy("pair_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("chosen").isNotNull() & F.col("chosen").eqNullSafe(F.col("rejected"))
    rows = aligned.withColumn("prompt", F.bool_and(same).over(before))
    for side in ("chosen", "rejected"):
        text, head = F.concat(F.lit("<|"), f"{side}.role", F.lit("|>\n"), f"{side}.text", F.lit(END + "\n")), F.length(f"{side}.role") + 5
        rows = rows.withColumn(f"{side}_text", text)
        # characters of the completion up to the end of this turn
        upto = F.sum(F.when(~F.col("prompt"), F.length(f"{side}_text"))).over(before)
        span = F.concat_ws(":", upto - F.length(f"{side}_text") + head, upto - 1)
        rows = rows.withColumn(f"{side}_span", F.when(~F.col("prompt") & (F.col(f"{side}.role") == "assistant"), span))

    def joined(column: str, prompt: bool, by: str) -> Column:
        kept = F.col("prompt") if prompt else ~F.col("prompt")
        listed = F.sort_array(F.collect_list(F.when(kept & F.col(column).isNotNull(), F.struct("turn", F.col(column).alias("x")))))
        return F.array_join(F.transform(listed, lambda t: t["x"]), by)

    return rows.groupBy("pair_id").agg(
        F.count_if("prompt").alias("prompt_turns"),
        joined("chosen_text", True, "").alias("prompt"),
        joined("chosen_text", False, "").alias("chosen"),
        joined("rejected_text", False, "").alias("rejected"),
        joined("chosen_span", False, ",").alias("chosen_mask"),
        joined("rejected_span", False, ",").alias("rejected_mask"),
    )
