"""Prefix trie of conversations that are rebuilt from the head of a base conversation and a suffix of their own.

A sequence of turns is an element (B^n, sum of t_i B^i) of a monoid: the pair of a concatenation follows from the pairs of its
parts. Turns are summed within cells of a conversation, cells are combined in order, and the fingerprint of any prefix of a
rebuilt conversation follows from prefixes of its base and of itself, so no rebuilt text ever exists. Four such sums modulo
2^31-1 make a fingerprint of 124 bits. Every group of equal fingerprints is then verified: its members must refer to one
stored turn content (the SHA-256 of role and text) at that depth. As equal fingerprints and equal last turns mean equal
fingerprints one turn earlier, that proves the whole sequences equal; a failure starts again with other bases.

A node belongs to its smallest member. That cuts the trie into chains, one for each conversation that is the smallest member
of its deepest nodes. A subtree holds, for each of its members, a part of that member's chain, so subtree sums are one
aggregation over members and need no walk through the levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import WORD, quoted

PRIME = (1 << 31) - 1
LANES = 4
#: Conversations and depths are worked on in blocks of this many turns, ids of one node in blocks of this many numbers.
BLOCK_BITS = 12
NODE = ["depth", "f1", "f2"]


def _bases(attempt: int) -> list[int]:
    """The bases of the four sums, others for each attempt."""
    return [int.from_bytes(hashlib.sha256(f"{attempt}:{lane}".encode()).digest()[:4], "big") % (PRIME - 3) + 2 for lane in range(LANES)]


def _powers(exponent: Column, bases: list[int]) -> Column:
    """base^exponent modulo the prime, for each base."""

    @F.pandas_udf("array<bigint>")
    def of(numbers: pd.Series) -> pd.Series:
        distinct, at = np.unique(numbers.to_numpy(np.int64), return_inverse=True)
        powers = np.array([[pow(b, int(n), PRIME) for b in bases] for n in distinct], np.int64).reshape(-1, len(bases))
        return pd.Series(list(powers[at]))

    return of(exponent)


def _lanes(make) -> Column:
    return F.array(*[make(lane) % PRIME for lane in range(LANES)])


def _packed(lanes: Column) -> tuple[Column, Column]:
    """Four 31-bit numbers in two longs."""
    return tuple((F.shiftleft(lanes[i], 31) + lanes[i + 1]) for i in (0, 2))


def _cells(turns: DataFrame, limit: int) -> DataFrame:
    """Turns with the keys k0..k3 of their cell: consecutive turns of a conversation, about `limit` at most.

    Cells are blocks of turn numbers. Crowded ones are cut by the number itself, then by content, then by place in the
    input, so a conversation whose turns all hold one number, or all are equal, is cut as well.
    """
    finer = [
        F.coalesce("at", F.lit(0)), F.conv(F.hex(F.substring("ref", 1, 4)), 16, 10).cast("long"), F.shiftright("rid", 10),
    ]
    cut = turns.withColumn("k0", F.coalesce(F.shiftright("at", 10), F.lit(-(1 << 62))))
    keys = ["conv", "k0"]
    for level, key in enumerate(finer, 1):
        crowded = cut.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(*keys, F.lit(True).alias("crowded"))
        if crowded.isEmpty():
            for rest in range(level, len(finer) + 1):
                cut = cut.withColumn(f"k{rest}", F.lit(0).cast("long"))
            return cut
        cut = cut.join(crowded, keys, "left").withColumn(f"k{level}", F.when(F.col("crowded"), key).otherwise(F.lit(0)).cast("long")).drop("crowded")
        keys.append(f"k{level}")
    return cut


def _rebuilt(turns: DataFrame, head: Column, base: Column, bases: list[int], limit: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, members): each conversation's length when rebuilt, and the fingerprint of each of its prefixes."""
    cell = ["conv", "k0", "k1", "k2", "k3"]
    upto = Window.partitionBy(*cell).orderBy("at", "ref", "rid")
    digit = [F.conv(F.hex(F.substring("ref", 4 * lane + 1, 4)), 16, 10).cast("long") % PRIME for lane in range(LANES)]
    numbered = _cells(turns, limit).withColumn("rn", F.row_number().over(upto)).withColumn("power", _powers(F.col("rn"), bases))
    terms = numbered.withColumn("term", _lanes(lambda i: digit[i] * F.col("power")[i]))
    local = stored(
        terms.withColumn("sum", F.array(*[F.sum(F.col("term")[i]).over(upto.rowsBetween(Window.unboundedPreceding, 0)) % PRIME for i in range(LANES)]))
        .select(*cell, "rn", "term", "sum", "ref", "tokens"),
        "trie-turns",
    )
    before = Window.partitionBy("conv").orderBy("k0", "k1", "k2", "k3").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(*cell).agg(F.count("*").alias("n"), *[F.sum(F.col("term")[i]).alias(f"s{i}") for i in range(LANES)])
    placed = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("shift", _powers(F.col("start"), bases))
    shifted = placed.select(*cell, "n", "start", "shift", *[(F.col(f"s{i}") % PRIME * F.col("shift")[i] % PRIME).alias(f"s{i}") for i in range(LANES)])
    cells = stored(
        shifted.withColumn("sum_before", F.array(*[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)) % PRIME for i in range(LANES)]))
        .select(*cell, "n", "start", "shift", "sum_before"),
        "trie-cells",
    )

    def place(rows: DataFrame, of: DataFrame) -> DataFrame:
        """Position in the conversation, and the sums up to that turn (own) and up to the one before (prior)."""
        own = _lanes(lambda i: F.col("sum_before")[i] + F.col("shift")[i] * F.col("sum")[i])
        prior = _lanes(lambda i: F.col("sum_before")[i] + F.col("shift")[i] * ((F.col("sum")[i] - F.col("term")[i] + PRIME) % PRIME))
        return rows.join(of, cell).withColumn("position", F.col("start") + F.col("rn")).withColumn("own", own).withColumn("prior", prior)

    # The first three turns at most, from the cells that hold them.
    first = place(local.filter("rn <= 3"), cells.filter("start < 3").select(*cell, "start", "shift", "sum_before")).filter("position <= 3")
    heads = first.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("position", "own", "prior", "ref", "tokens"))).alias("turns"))
    lengths = cells.groupBy("conv").agg(F.sum("n").alias("n")).join(heads, "conv").withColumn("h", head).withColumn("base", base)
    bare = F.array(*[F.lit(0).cast("long")] * LANES)
    with_base = lengths.join(heads.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns")), "base", "left")
    shared = F.coalesce(F.slice("base_turns", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    convs = stored(
        with_base.withColumn("shared", shared).withColumn("taken", F.size("shared"))
        .withColumn("from", F.when(F.col("taken") > 0, F.try_element_at("shared", F.col("taken"))["own"]).otherwise(bare))
        .withColumn("skip", F.when(F.col("h") > 0, F.try_element_at("turns", F.least("h", "n").cast("int"))["own"]).otherwise(bare))
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv", "h", "base", "shared", "taken", "from", "skip", "length"),
        "trie-conversations",
    )
    # base^(taken - h), an inverse power if the base conversation is shorter than the head asked for
    back = [F.array(*[F.lit(pow(b, -k, PRIME)) for b in bases]) for k in range(4)]
    away = F.array(*back)[(F.col("h") - F.col("taken")).cast("int")]

    def after(sums: str) -> Column:
        return _lanes(lambda i: F.col("from")[i] + (F.col(sums)[i] - F.col("skip")[i] + PRIME) % PRIME * F.col("away")[i])

    mine = cells.join(convs.drop("shared", "base"), "conv").withColumn("away", away)
    suffix = place(local, mine).filter("position > h").select(
        "conv", (F.col("taken") + F.col("position") - F.col("h")).alias("depth"), after("own").alias("f"), after("prior").alias("p"), "ref", "tokens", "length",
        F.col("conv").alias("turn_conv"), "position",
    )
    head_rows = convs.select("conv", "length", "base", F.explode("shared").alias("t")).select(
        "conv", F.col("t.position").alias("depth"), F.col("t.own").alias("f"), F.col("t.prior").alias("p"), "t.ref", "t.tokens", "length",
        F.col("base").alias("turn_conv"), "t.position",
    )
    roots = convs.select(
        "conv", F.lit(0).cast("long").alias("depth"), bare.alias("f"), F.lit(None).cast("array<bigint>").alias("p"), F.lit(None).cast("binary").alias("ref"),
        F.lit(0).cast("long").alias("tokens"), "length", F.lit(None).cast(turns.schema["conv"].dataType).alias("turn_conv"), F.lit(None).cast("long").alias("position"),
    )
    (f1, f2), (p1, p2) = _packed(F.col("f")), _packed(F.col("p"))
    every = suffix.unionByName(head_rows).unionByName(roots)
    members = stored(
        every.select("conv", F.col("depth").cast("long").alias("depth"), f1.alias("f1"), f2.alias("f2"), p1.alias("p1"), p2.alias("p2"), "ref", "tokens", "length", "turn_conv", "position"),
        "trie-members",
    )
    return convs.select("conv", "length"), members


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, in order, joined by commas.

    Ids are joined in blocks of neighbouring numbers; only the finished strings of a node pass one task, one after the other,
    as the digest is sequential by definition. Nothing is held but its state.
    """
    parts = ends.groupBy(*NODE, F.shiftright("conv", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    text = parts.select(*NODE, "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*NODE, "ends_sha256"])

        node, state, done = None, None, []
        for batch in batches:
            for *key, _, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(said.encode())
                else:
                    state.update(b"," + said.encode())
            yield out(done)
            done = []
        if node is not None:
            yield out([(*node, state.hexdigest())])

    return text.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(run, "depth long, f1 long, f2 long, ends_sha256 string")


def _parents(nodes: DataFrame, chains: DataFrame, children: DataFrame, count: int) -> DataFrame:
    """(owner, parent): the owner of the node that each chain hangs from.

    Nodes with very many children are looked up in a broadcast table: the limit rises with the number of nodes, so that at
    most 50,000 nodes can exceed it.
    """
    heads = nodes.join(chains.select("owner", F.col("top").alias("depth")), ["owner", "depth"]).filter("depth > 0")
    wanted = heads.select(F.col("owner").alias("child"), (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    owners = nodes.select(*NODE, F.col("owner").alias("parent"))
    limit = max(10_000, count // 50_000)
    crowded = owners.join(children.filter(F.col("n_children") > limit).select(*NODE), NODE)
    tried = stored(wanted.join(F.broadcast(crowded), NODE, "left"), "trie-chains")
    others = tried.filter("parent is null").drop("parent").join(owners, NODE)
    return tried.filter("parent is not null").select("child", "parent").unionByName(others.select("child", "parent")).withColumnRenamed("child", "owner")


def prefix_trie(
    turns: DataFrame, head: Column, base: Column, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", limit: int = 8192,
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included.

    `head` (0 to 3) and `base` are expressions over the column `conv`: a conversation is rebuilt from the first `head` turns of
    conversation `base` (all if it has fewer, none if there is none) and its own turns after its first `head`. Returns conv_id
    (the node's smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    turn_conv, turn_position (from 1): where the node's last turn is stored. conv_id must be a whole number.

    Turns are ordered by number, null first, equal numbers by the SHA-256 of role and text; repeated rows are turns each. Null
    roles and texts equal empty ones. Rows without a conversation id take no part. Very long texts are hashed where they lie and
    never moved, very long conversations are cut into cells. An empty table gives no rows.
    """
    role, text = F.coalesce(quoted(role_column), F.lit("")), F.coalesce(quoted(text_column), F.lit(""))
    given = stored(
        turns.select(
            quoted(conv_column).cast("long").alias("conv"), quoted(turn_column).cast("long").alias("at"),
            F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("ref"),
            F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("tokens"), F.monotonically_increasing_id().alias("rid"),
        ).filter("conv is not null"),
        "trie-given",
    )
    attempt = 0
    while True:
        convs, members = _rebuilt(given, head, base, _bases(attempt), limit)
        last = F.min(F.struct("conv", "turn_conv", "position")).alias("first")
        nodes = stored(
            members.groupBy(*NODE).agg(
                last, F.count("*").alias("n_convs"), F.max("tokens").alias("tokens"), F.max("length").alias("deepest"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                F.min("ref").eqNullSafe(F.max("ref")).alias("verified"),
            ).select(*NODE, F.col("first.conv").alias("owner"), "first.turn_conv", "first.position", "n_convs", "tokens", "deepest", "p1", "p2", "verified"),
            "trie-nodes",
        )
        if nodes.filter("not verified").isEmpty():
            break
        attempt += 1
    count = nodes.count()
    saved = (F.col("n_convs") - 1) * F.col("tokens")
    block = F.shiftright("depth", BLOCK_BITS).alias("block")
    # Chains: per owner its topmost node, all it saves, and whether it ends in a leaf; per block what lies before it.
    blocks = nodes.groupBy("owner", block).agg(F.min("depth").alias("top"), F.sum(saved).alias("saved"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    chains = stored(blocks.groupBy("owner").agg(F.min("top").alias("top"), F.sum("saved").alias("chain"), F.max("leaf").alias("leaf")), "trie-tops")
    earlier = Window.partitionBy("owner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("before", F.coalesce(F.sum("saved").over(earlier), F.lit(0))).select("owner", "block", "before")
    above = Window.partitionBy("owner", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        nodes.withColumn("block", block).withColumn("inside", F.coalesce(F.sum(saved).over(above), F.lit(0))).join(offsets, ["owner", "block"])
        .withColumn("above", F.col("before") + F.col("inside"))
    )
    # Every member brings its whole chain to each node it passes; the owner's part above the node is taken off again.
    by_block = convs.join(chains, F.col("conv") == F.col("owner")).select("conv", "chain", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("length", BLOCK_BITS))).alias("block"))
    brought = members.select("conv", *NODE, block).join(by_block, ["conv", "block"]).groupBy(*NODE).agg(F.sum("chain").alias("chains"), F.sum("leaf").alias("n_leaves"))
    children = stored(
        nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children")), "trie-children"
    )
    ends = _digests(members.filter("depth = length").select(*NODE, "conv"))
    parents = _parents(nodes, chains, children, count)
    joined = placed.join(brought, NODE, "left").join(children, NODE, "left").join(ends, NODE, "left")
    tops = chains.select("owner", "top").join(parents, "owner", "left")
    top_blocks = tops.join(blocks.select("owner", "block"), "owner")
    return joined.join(top_blocks, ["owner", "block"]).select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") > F.col("top"), F.col("owner")).when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("chains", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        "turn_conv", F.col("position").alias("turn_position"),
    )
