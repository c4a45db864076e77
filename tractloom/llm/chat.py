"""Chat formatting: conversations logged as growing snapshots collapse to the longest ones, which are then rendered.

Every turn gets a rolling hash of its conversation up to there: the exclusive-or of hashes over (position, role, text), so it
is a sum and needs no whole conversation in one place. A conversation whose full hash is a proper prefix of another one is
a snapshot and dropped by an anti-join. Positions and hashes are summed first within blocks of turns, then over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import quoted


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """Turns in blocks by turn number: (conv, at, role, text, b), exact repetitions removed."""
    return turns.distinct().withColumn("b", F.floor(F.coalesce("at", F.lit(-1)) / block).cast("long"))


def numbered(turns: DataFrame, block: int) -> DataFrame:
    """Turns (conv, at, role, text) with position (from 1) and the two 64-bit hashes h1, h2 of all turns up to there."""
    cut = stored(_blocks(turns, block), "chat-turns")
    earlier = Window.partitionBy("conv").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv", "b").orderBy(F.col("at").asc_nulls_first(), "role", F.xxhash64("text"), "text")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    starts = cut.groupBy("conv", "b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = cut.alias("t").join(starts.alias("s"), F.col("t.conv").eqNullSafe(F.col("s.conv")) & (F.col("t.b") == F.col("s.b"))).select("t.*", "before")
    said = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))]
    rolled = stored(
        placed.withColumn("position", F.row_number().over(within) + F.col("before"))
        .withColumn("h1", F.xxhash64("position", *said)).withColumn("h2", F.xxhash64(F.lit("second"), *said, "position"))
        .withColumn("r1", F.bit_xor("h1").over(upto)).withColumn("r2", F.bit_xor("h2").over(upto)),
        "chat-rolled",
    )
    sums = rolled.groupBy("conv", "b").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    before = sums.select("conv", "b", *[F.coalesce(F.bit_xor(h).over(earlier), F.lit(0)).alias(f"b{h}") for h in ("h1", "h2")])
    return rolled.alias("t").join(before.alias("s"), F.col("t.conv").eqNullSafe(F.col("s.conv")) & (F.col("t.b") == F.col("s.b"))).select(
        "t.conv", "at", "role", "text", "position", F.col("r1").bitwiseXOR(F.col("bh1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("bh2")).alias("h2")
    )


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def format_chats(
    turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    turns_in_piece: int = 512, block: int = 1024,
) -> DataFrame:
    """The conversations that prefix no other, rendered: conv_id, piece, n_turns, n_pieces, n_snapshots, text.

    Turns are ordered by number, null first, equal numbers by role and text; exact repetitions of a turn count once. A
    conversation equal to another in all turns goes if the other has a smaller id (null is the largest). n_snapshots counts the
    dropped conversations, snapshots and equals, that this one covers; one prefix may count for several. Null roles and texts
    render as empty but differ from empty ones when compared. A long conversation comes in pieces of turns_in_piece turns. An
    empty table gives no rows.
    """
    given = turns.select(quoted(conv_column).alias("conv"), quoted(turn_column).alias("at"), quoted(role_column).alias("role"), quoted(text_column).alias("text"))
    rolled = stored(numbered(given, block), "chat-hashed")
    length = rolled.groupBy("conv").agg(F.max("position").alias("turns"))
    same = F.col("r.conv").eqNullSafe(F.col("l.conv"))
    whole = stored(
        rolled.alias("r").join(length.alias("l"), same & (F.col("r.position") == F.col("l.turns"))).select("r.conv", "turns", "h1", "h2"), "chat-whole"
    )
    key = ["turns", "h1", "h2"]
    # Of equal conversations the smallest id; a null id only if there is no other.
    firsts = whole.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("equal"))
    prefixes = rolled.alias("r").join(length.alias("l"), same & (F.col("r.position") < F.col("l.turns"))).select(F.col("position").alias("turns"), "h1", "h2").distinct()
    maximal = stored(firsts.join(prefixes, key, "left_anti"), "chat-maximal")
    dropped = firsts.join(prefixes, key, "left_semi").select(F.col("turns").alias("position"), "h1", "h2", "equal")
    mine = F.col("r.conv").eqNullSafe(F.col("m.conv"))
    kept = rolled.alias("r").join(maximal.select("conv", "turns", "equal").alias("m"), mine).select("r.*", "turns", F.col("equal").alias("alike"))
    marked = kept.join(dropped, ["position", "h1", "h2"], "left")
    piece = F.floor((F.col("position") - 1) / turns_in_piece).cast("int")
    pieces = stored(
        marked.withColumn("piece", piece).groupBy("conv", "piece", "turns", "alike")
        .agg(F.sum(F.coalesce("equal", F.lit(0))).alias("covered"), F.sort_array(F.collect_list(F.struct("position", rendered_turn(F.col("role"), F.col("text")).alias("said")))).alias("said"))
        .select("conv", "piece", "turns", "alike", "covered", F.array_join(F.transform("said", lambda x: x["said"]), "").alias("text")),
        "chat-pieces",
    )
    covered = pieces.groupBy(F.col("conv").alias("c")).agg(F.sum("covered").alias("covered"))
    return pieces.drop("covered").join(covered, F.col("conv").eqNullSafe(F.col("c"))).select(
        F.col("conv").alias("conv_id"), "piece", F.col("turns").cast("long").alias("n_turns"), F.ceil(F.col("turns") / turns_in_piece).cast("int").alias("n_pieces"),
        (F.col("covered") + F.col("alike") - 1).cast("long").alias("n_snapshots"), "text",
    )
