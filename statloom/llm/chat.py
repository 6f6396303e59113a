"""Chat formatting: logged snapshots collapse to their longest conversation, which is then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import materialize

#: Turns in one block of a conversation, and in one rendered row.
BLOCK_TURNS = 512

#: (opening, closing) around a turn; {role} stands for its role.
TEMPLATE = ("<|im_start|>{role}\n", "<|im_end|>\n")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, …), block, role, text and the rolling hashes h1, h2 of all turns up to this one.

    Turns lie in the order of turn (null first), role and text; an exact repetition of a turn counts
    once. A prefix hash is the sum of the hashes of (place, role, text) so far, in two independent
    64-bit halves: sums add up over blocks of turns, so that a conversation of any length is hashed in
    pieces of BLOCK_TURNS turn numbers.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).distinct()
    blocks = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62)).cast("bigint")))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = blocks.groupBy("conv_id", "block").agg(F.count("*").alias("held"))
    before = held.select("conv_id", "block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    placed = _meet(blocks.withColumn("at", F.row_number().over(inside)), before).withColumn("place", F.col("before") + F.col("at"))
    for half, seed in (("1", 11), ("2", 29)):
        # As decimals, sums of 64-bit terms do not overflow.
        placed = placed.withColumn(f"x{half}", F.xxhash64(F.lit(seed), F.col("place"), F.col("role"), F.col("text")).cast("decimal(20,0)"))
    sums = placed.groupBy("conv_id", "block").agg(F.sum("x1").alias("s1"), F.sum("x2").alias("s2"))
    carried = sums.select("conv_id", "block", *(F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).alias(f"c{k}") for k in "12"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _meet(placed, carried)
    return joined.select("conv_id", "place", "role", "text", *((F.col(f"c{k}") + F.sum(f"x{k}").over(so_far)).cast("string").alias(f"h{k}") for k in "12"))


def _meet(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    return turns.alias("t").join(blocks.alias("b"), F.expr("t.conv_id <=> b.conv_id and t.block = b.block")).select("t.*", *[f"b.{c}" for c in blocks.columns[2:]])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other one extends; of equal ones the smallest conv_id.

    `turns` is the table of `numbered`. A conversation goes when its whole (length, hashes) is among
    the prefixes of a longer one. A null conv_id is a conversation of its own and sorts last.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    marked = turns.alias("t").join(sizes.alias("s"), F.expr("t.conv_id <=> s.conv_id")).select("t.conv_id", "t.place", "t.h1", "t.h2", "s.n_turns")
    whole = marked.where("place = n_turns").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where("place < n_turns").select("place", "h1", "h2").distinct()
    return whole.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(conversations: DataFrame, template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, part, first_place, last_place and rendered of every maximal conversation.

    A conversation is rendered as rows of BLOCK_TURNS turns, part 0, 1, …; joined in order they are its
    text. A null role renders as `unknown`, a null text as an empty one. Conversations that a longer
    one starts with, and repetitions, are left out whole. An empty table gives no rows; other columns
    are ignored.
    """
    turns = materialize(numbered(conversations), "turns")
    kept = maximal(turns)
    opening, closing = template
    head, _, tail = opening.partition("{role}")
    line = F.concat(F.lit(head), F.coalesce("role", F.lit("unknown")), F.lit(tail), F.coalesce("text", F.lit("")), F.lit(closing))
    lines = turns.alias("t").join(kept.alias("k"), F.expr("t.conv_id <=> k.conv_id")).select(
        "t.conv_id", "k.n_turns", F.floor((F.col("t.place") - 1) / BLOCK_TURNS).alias("part"), F.col("t.place").alias("place"), line.alias("line")
    )
    parts = lines.groupBy("conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return parts.select(
        "conv_id", "n_turns", "part", F.element_at("lines", 1)["place"].alias("first_place"), F.element_at("lines", -1)["place"].alias("last_place"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"),
    )
