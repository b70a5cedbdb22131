"""Chat logs: drop snapshots that a longer log continues, render the rest.

A conversation that is logged after every turn leaves logs of which each is a
prefix of the next. A prefix hash of the first k turns is the xor of 128-bit
hashes of (place, role, text), so it can be rolled over blocks of turns: the
turns of a conversation are placed and hashed block by block, the blocks' own
sums are rolled over the conversation, and no task needs a whole conversation.
The hashes of all proper prefixes, reduced to distinct ones, are what whole
conversations are anti-joined with; equal whole conversations keep the one with
the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litframe.llm.frames import empty_text, stage

#: Turns that are placed, hashed and rendered together.
BLOCK = 64


def _halves(*parts: Column) -> tuple[Column, Column]:
    """128 bits over the parts as two longs."""
    both = F.md5(F.concat_ws("\x1f", *parts))
    return tuple(
        F.conv(F.substring(both, at, 16), 16, -10).cast("long") for at in (1, 17)
    )


def placed_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, block, place, role, text`` with the rolled prefix hashes ``a, b``.

    Places count from 0 in the order of (turn, role, text), nulls first and as
    empty; repeated turns are kept and stand side by side.
    """
    rows = turns.select(
        "conv_id", "turn", empty_text("role").alias("role"), empty_text("text").alias("text"),
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block).alias("block"),
    )
    # conversations are matched null-safe by a hash of their id where it is null
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("conv_id").alias("c"), F.col("block").alias("k"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    placed = rows.withColumn("at", F.row_number().over(in_block) - 1).join(
        starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))
    ).withColumn("place", F.col("start") + F.col("at"))
    high, low = _halves(F.col("place").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text"))
    return placed.select("conv_id", "block", "place", "role", "text", high.alias("ha"), low.alias("hb"))


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """``conv_id, place, a, b``: the hash of turns 0 to place of each conversation."""
    within = Window.partitionBy("conv_id", "block").orderBy("place")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    xor = lambda name: F.bit_xor(name)
    blocks = placed.groupBy("conv_id", "block").agg(xor("ha").alias("sa"), xor("hb").alias("sb"))
    carried = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("k"),
        *(F.coalesce(xor(s).over(before), F.lit(0)).alias(f"p{s}") for s in ("sa", "sb")),
    )
    rolled = placed.select(
        "conv_id", "block", "place",
        xor("ha").over(within).alias("ra"), xor("hb").over(within).alias("rb"),
    )
    return rolled.join(
        carried, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))
    ).select(
        "conv_id", "place",
        F.col("ra").bitwiseXOR(F.col("psa")).alias("a"), F.col("rb").bitwiseXOR(F.col("psb")).alias("b"),
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``conv_id, turns`` of conversations that no longer one continues."""
    last = prefixes.groupBy("conv_id").agg(F.max("place").alias("last"))
    hashes = prefixes.join(
        last.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))
    ).drop("c")
    whole = (
        hashes.filter("place = last")
        .groupBy("place", "a", "b")
        .agg(F.min(F.struct(F.col("conv_id").isNull().alias("unknown"), "conv_id")).getField("conv_id").alias("conv_id"))
    )
    inner = hashes.filter("place < last").select("place", "a", "b").distinct()
    return whole.join(inner, ["place", "a", "b"], "left_anti").select(
        "conv_id", (F.col("place") + 1).alias("turns")
    )


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the chat template; marks inside the text are taken apart."""
    inside = F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "< |$1| >")
    named = F.regexp_replace(role, r"[<|>\s]+", "_")
    return F.concat(F.lit("<|im_start|>"), named, F.lit("\n"), inside, F.lit("<|im_end|>\n"))


def chat_parts(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Maximal conversations in the chat template, in parts of at most a block.

    Returns ``conv_id, turns, part, first_turn, text``; a conversation's text is
    its parts one after the other. Parts are cut by the value of ``turn``, so a
    conversation of any length is spread over tasks. Null ids form one
    conversation. An empty table gives no rows; columns other than ``conv_id,
    turn, role, text`` are not read.
    """
    placed = stage(placed_turns(turns, block), "turns")
    whole = maximal_conversations(prefix_hashes(placed)).withColumnRenamed("conv_id", "c")
    kept = placed.join(whole, F.col("conv_id").eqNullSafe(F.col("c")))
    rendered = kept.select(
        "conv_id", "turns", F.floor(F.col("place") / block).alias("part"), "place",
        render_turn(F.col("role"), F.col("text")).alias("piece"),
    )
    return rendered.groupBy("conv_id", "turns", "part").agg(
        F.min("place").alias("first_turn"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), ""
        ).alias("text"),
    )
