"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once
with that speaker as the assistant; everybody else is a named user, and only
the assistant's own words (with their end mark) are to be learnt.  System
messages belong to nobody: they stay system messages and are no perspective.

The result has a row for each message of each rendering: the segment of text,
where it begins in the rendering, and which part of it is to be learnt.  The
segments in order are the rendering.  A conversation of any length is never
gathered: offsets come from sums over blocks of turns and sums before a block.

A mark inside a text or a name could end a message or begin one, so a
zero-width space is put behind its `<`; line feeds in a name become spaces.

Defined results: a null text is an empty message; a null or empty role is the
speaker `unknown`; turns are ordered by number, null turns first, ties by role
and rendered segment; a
conversation of system messages alone has no perspective and no rows; an empty
table gives an empty one; other columns are left behind.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
BLOCK_TURNS = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _unmarked(c: Column) -> Column:
    return F.replace(c, F.lit("<|im_"), F.lit("<\u200b|im_"))


def _head(role: Column, name: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """Messages of every rendering, with offsets and the learnt spans."""
    speaker = F.translate(F.trim("role"), "\r\n", "  ")
    speaker = F.when(F.trim(speaker) == "", None).otherwise(F.trim(speaker))
    # null conversations and turns are keys like any other, without null-safe joins that would deal the rows out again
    turns = conversations.select("conv_id", "turn", F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"),
                                 _unmarked(F.coalesce(speaker, F.lit(UNKNOWN))).alias("speaker"), _unmarked(F.coalesce("text", F.lit(""))).alias("text"))
    parties = turns.where(F.col("speaker") != SYSTEM).select("conv", "no_conv", F.col("speaker").alias("perspective")).distinct()
    views = turns.join(parties, ["conv", "no_conv"])
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(~own & (F.col("speaker") != SYSTEM), F.col("speaker"))
    head = _head(role, name)
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    views = views.select("conv_id", "conv", "no_conv", "perspective", "turn", role.alias("role"), name.alias("name"), "speaker", own.alias("learnt"),
                         F.concat(head, F.col("text"), F.lit(CLOSE)).alias("segment"), F.length(head).alias("head"),
                         F.col("turn").isNotNull().alias("timed"), F.coalesce(block, F.lit(0)).alias("block"))
    views = views.withColumn("size", F.length("segment"))
    rendering = ["conv", "no_conv", "perspective"]
    key = [*rendering, "timed", "block"]
    in_order = Window.partitionBy(*key).orderBy("turn", "speaker", "segment")
    earlier = Window.unboundedPreceding, -1
    before = Window.partitionBy(*rendering).orderBy("timed", "block").rowsBetween(*earlier)
    blocks = views.groupBy(*key).agg(F.sum("size").alias("n"), F.count("*").alias("c"))
    blocks = blocks.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("past_rows"))
    views = views.withColumn("in_block", F.coalesce(F.sum("size").over(in_order.rowsBetween(*earlier)), F.lit(0))).withColumn("nth", F.row_number().over(in_order))
    views = views.join(blocks, key)
    start = F.col("past") + F.col("in_block")
    learnt = F.col("learnt")
    return views.select(
        "conv_id", "perspective", (F.col("past_rows") + F.col("nth") - 1).cast("bigint").alias("position"), "turn", "role", "name", "segment",
        start.cast("bigint").alias("start"), (start + F.col("size")).cast("bigint").alias("end"), "learnt",
        F.when(learnt, start + F.col("head")).cast("bigint").alias("learnt_start"), F.when(learnt, start + F.col("size") - 1).cast("bigint").alias("learnt_end"))
