"""Chat formatting after cumulative-snapshot collapse.

Chat logs often hold a conversation once per turn, each snapshot being a prefix
of the next. A rolling hash over the turns gives every prefix a key, so the
conversations that are proper prefixes of longer ones fall to one anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm._spark import checkpoint


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, h1, h2``: place in the conversation and the 128-bit key of the prefix ending there.

    The key is the running xor of hashes of (place, role, text): equal keys mean
    equal turn sequences. A turn without a conversation is left out; ties in
    ``turn`` are ordered by role, then text; null roles and texts are kept apart
    from empty ones.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return (
        turns.select("conv_id", "turn", "role", "text")
        .where(F.col("conv_id").isNotNull())
        .withColumn("place", F.row_number().over(order).cast("long"))
        .withColumn("h1", F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(rolling))
        .withColumn("h2", F.bit_xor(F.xxhash64(F.lit(2), *parts)).over(rolling))
    )


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the maximal conversations.

    Dropped are conversations whose turns are a proper prefix of another's;
    among equal ones the smallest ``conv_id`` stays and ``n_copies`` counts them.
    Grouping by key combines before it shuffles, so a first turn shared by a
    third of all conversations is one row per task.
    """
    keys = checkpoint(prefix_keys(turns).select("conv_id", "place", "h1", "h2"))
    whole = keys.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("last")).select("conv_id", "last.*")
    kept = whole.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    ends = whole.select("conv_id", F.col("place").alias("n_turns"))
    inner = keys.join(ends, "conv_id").where(F.col("place") < F.col("n_turns")).select("place", "h1", "h2").distinct()
    return kept.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, rendered``: each kept conversation as ``<|role|>`` blocks in turn order (null role: unknown; null text: empty)."""
    placed = prefix_keys(turns).select("conv_id", "place", "role", "text")
    block = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    return (
        placed.join(conversations.select("conv_id"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("blocks"))
        .select("conv_id", F.array_join("blocks.block", "").alias("rendered"))
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered`` of the maximal conversations.

    A conversation is one training example, so its turns meet in one row; an
    empty table gives an empty result and other columns are ignored.
    """
    kept = checkpoint(collapse_snapshots(turns))
    return kept.join(render(turns, kept), "conv_id")
