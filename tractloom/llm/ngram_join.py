"""Near-duplicate join on word n-grams: a forest of min-hash tries, then exact verification.

Texts become sets of hashed word n-grams; equal sets collapse to one representative. In each tree of the forest the signatures
are sorted, so that the longest prefix a set shares with any other stands beside it: its run in the trie. Sets meet at first
only if they share a whole signature of some tree. The pairs verified so far tell, by their exact similarities, which share of
all links such meetings find; while it is below the target, matched prefixes are shortened to the longest length that reaches
it, and what meets anew is verified. Shortening ends for certain where even sets at the threshold meet with that chance.

Chains of meetings bound neighbourhoods, inside which sets are compared in full, block against block, without emitting pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import CHUNK_BITS, aligned, hashes, joins_by_part_of_key, mixed, quoted, row_and_text, with_found, words
from .components import components

TREES, DEPTH = 24, 8
BLOCK = 256
#: Width of a bin of similarities; bytes of one value of a signature.
BIN, WIDTH = 0.01, 2


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """With which sets of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, target: float, depth: int = DEPTH) -> int:
    """The longest prefix at which sets of this similarity meet in some tree with the target probability."""
    while depth > 1 and chance(threshold, depth) < target:
        depth -= 1
    return depth


def next_depth(found: dict[int, int], depth: int, threshold: float, target: float) -> int:
    """The longest prefix, up to `depth`, whose estimated recall is the target; `found` counts verified links by bin of similarity.

    A link of similarity s was found with chance(s, depth), so it stands for one over that many. Its bin's lower end is
    taken, and one link at the threshold is added, so that few links are no proof.
    """
    lows = {b: min(1.0, threshold + b * BIN) for b in found}
    total = [(lows[b], count / chance(lows[b], depth)) for b, count in found.items()] + [(threshold, 1.0)]
    while depth > 1 and sum(w * chance(s, depth) for s, w in total) < target * sum(w for _, w in total):
        depth -= 1
    return depth


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Ordered distinct hashes of each text's n-grams of lower-case words; a shorter text is one gram; none if it has no word."""
    codes, offsets, names = words(texts)
    word = hashes(names)[codes] if len(names) else np.zeros(0, np.uint64)
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = word[start:end]
        if end == start:
            out.append(own)
            continue
        size = min(n, end - start)
        gram = np.full(end - start - size + 1, size, np.uint64)
        for j in range(size):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + own[j : j + len(gram)]
        out.append(np.unique(mixed(gram)))
    return out


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (seeds[:count] | np.uint64(1)).astype(np.uint32), seeds[count:].astype(np.uint32)


def signature(own: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, in slices that fit the cache, folded to 16 bits.

    Values that agree in these bits only make sets meet once in 65,536 cases more; meetings are verified.
    """
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(best, (low[at : at + 512, None] * factors[None, :] + shifts[None, :]).min(0), out=best)
    return (best ^ (best >> np.uint32(16))).astype(np.uint16)


SKETCH = "rid long, chunk long, low long, high long, grams long, sig binary"


def _sketches(n: int):
    factors, shifts = _multipliers(TREES * DEPTH)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                low, high, size, sig = [], [], [], []
                for own in shingles(b.column("text"), n):
                    low.append(int(own.sum(dtype=np.uint64).astype(np.int64)))
                    high.append(int(mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    size.append(len(own))
                    sig.append(signature(own, factors, shifts).byteswap().tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid"), b.column("chunk"), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())],
                    names=["rid", "chunk", "low", "high", "grams", "sig"],
                )

    return run


def _sets(n: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                own = [s.astype("<u8").tobytes() for s in shingles(b.column("text"), n)]
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("area"), b.column("copies"), pa.array(own, pa.binary())], names=["rep", "area", "copies", "grams"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from shared grams only, in dense slices of bounded width."""
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(flat_l, flat_r)
    row_l, row_r = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    out = np.zeros((len(left), len(right)), np.float32)
    if len(shared) == 0:
        return out
    at_l, at_r = np.searchsorted(shared, flat_l), np.searchsorted(shared, flat_r)
    ok_l, ok_r = (shared[np.minimum(a, len(shared) - 1)] == f for a, f in ((at_l, flat_l), (at_r, flat_r)))
    (row_l, at_l), (row_r, at_r) = (row_l[ok_l], at_l[ok_l]), (row_r[ok_r], at_r[ok_r])
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    row_l, at_l, row_r, at_r = row_l[order_l], at_l[order_l], row_r[order_r], at_r[order_r]
    for start in range(0, len(shared), 8192):
        width = min(8192, len(shared) - start)
        a, b = (np.zeros((len(x), width), np.float32) for x in (left, right))
        for m, row, at in ((a, row_l, at_l), (b, row_r, at_r)):
            lo, hi = np.searchsorted(at, (start, start + width))
            m[row[lo:hi], at[lo:hi] - start] = 1
        out += a @ b.T
    return out


def _matches(floor: int):
    """Rows sorted by tree and signature: (a, b, depth) if a shares a prefix of `depth` values with b, the least of its run.

    A run holds the rows that share a prefix; runs of at least `floor` values count. At each depth the first row of a run, and the
    first of each longer run inside it, is paired with the run's least row, so at any depth the pairs connect exactly its runs. The
    least row is mostly the same in all trees, so a large group has few different pairs. If a run goes on in the next batch and has
    a lesser row there, the two are paired. Only one row and the least rows of its runs are kept between batches.
    """

    def run(batches):
        before, least = np.full((1, DEPTH + 1), -1, np.int64), np.zeros(DEPTH + 1, np.int64)
        for b in batches:
            if b.num_rows == 0:
                continue
            rep = b.column("rep").to_numpy()
            values = np.frombuffer(b"".join(b.column("label").to_pylist()), "<u2").reshape(-1, DEPTH)
            rows = np.column_stack([b.column("tree").to_numpy(), values]).astype(np.int64)
            same = rows == np.concatenate([before, rows[:-1]])
            shared = np.cumprod(same, 1).sum(1) - 1  # the tree is the first column; -1 if even that differs
            out = []
            for depth in range(floor, DEPTH + 1):
                starts = shared < depth
                firsts = np.flatnonzero(np.concatenate([[True], starts[1:]]))
                lows = np.minimum.reduceat(rep, firsts)
                if not starts[0]:  # goes on from the batch before
                    out.append((least[depth : depth + 1].copy(), lows[:1].copy(), np.array([depth], np.int32)))
                    lows[0] = min(lows[0], least[depth])
                least[depth] = lows[-1]
                here = np.flatnonzero(shared <= depth)
                low = lows[np.searchsorted(firsts, here, "right") - 1]
                other = low != rep[here]
                out.append((rep[here][other], low[other], np.full(int(other.sum()), depth, np.int32)))
            before = rows[-1:]
            a, low, depth = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(low, pa.int64()), pa.array(depth, pa.int32())], names=["a", "b", "depth"])

    return run


def matches(sets: DataFrame, floor: int) -> DataFrame:
    """(a, b, depth): what meets in the sorted tries of `sets` (rep, sig), at the longest prefix at which it does."""
    span = WIDTH * DEPTH
    leaves = (
        sets.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .select("rep", "tree", F.expr(f"substring(sig, tree * {span} + 1, {span})").alias("label"))
    )
    # Rows that share a prefix of `floor` values come to one task, sorted; the task streams over them.
    dealt = leaves.repartition("tree", F.substring("label", 1, WIDTH * floor)).sortWithinPartitions("tree", "label", "rep")
    return dealt.mapInArrow(_matches(floor), "a long, b long, depth int").filter("a <> b").groupBy("a", "b").agg(F.max("depth").alias("depth"))


#: Kinds of rows: copies that a is linked to; an edge a-b that spans a class; number of linked pairs of area b in bin a.
COPIES, EDGE, PAIRS = 0, 1, 2
CHECKED = "kind int, a long, b long, links long"


def _check(threshold: float):
    """Compare two blocks of an area (or one with itself) and return rows of the three kinds."""

    def run(rows: pa.Table) -> pa.Table:
        ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        blocks, side = rows.column("block").to_numpy(), rows.column("other").to_numpy()
        sets = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("grams")]
        low, high = int(min(blocks.min(), side.min())), int(max(blocks.max(), side.max()))
        left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        sizes = np.array([len(s) for s in sets])
        both = _overlaps([sets[i] for i in left], [sets[i] for i in right])
        # The exact test on whole numbers: |A & B| >= t |A or B|, counts are far below 2**24.
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked = both >= threshold * union - 1e-6
        if low == high:
            np.fill_diagonal(linked, False)
        out_a, out_n = [ids[left]], [linked @ copies[right]]
        if low != high:
            out_a.append(ids[right])
            out_n.append(linked.T @ copies[left])
        edges = _spanning(ids[left], ids[right], linked)
        a, n = np.concatenate(out_a), np.concatenate(out_n).astype(np.int64)
        a, n = a[n > 0], n[n > 0]
        once = np.triu(linked) if low == high else linked
        bins, pairs = np.unique(np.floor((both[once] / union[once] - threshold) / BIN + 1e-9).clip(0).astype(np.int64), return_counts=True)
        return pa.table({
            "kind": pa.array(np.repeat([COPIES, EDGE, PAIRS], [len(a), len(edges[0]), len(bins)]), pa.int32()),
            "a": pa.array(np.concatenate([a, edges[0], bins]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(edges[1], pa.int64()), pa.array(np.full(len(bins), rows.column("area")[0].as_py()), pa.int64())]),
            "links": pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(edges[0]), pa.int64()), pa.array(pairs, pa.int64())]),
        })

    return run


def _spanning(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as connect what the link matrix connects: from each node of a search to the least, where it began."""
    nodes = {int(x): i for i, x in enumerate(np.unique(np.concatenate([left, right])))}
    reach: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k, x in enumerate(left.tolist()):
        reach.setdefault(x, []).append((right, linked[k]))
    for k, x in enumerate(right.tolist()):
        reach.setdefault(x, []).append((left, linked[:, k]))
    seen, edges = set(), []
    for root in nodes:
        if root in seen:
            continue
        seen.add(root)
        todo = [root]
        while todo:
            x = todo.pop()
            for others, hit in reach[x]:
                for y in others[hit].tolist():
                    if y not in seen:
                        seen.add(y)
                        edges.append((y, root))
                        todo.append(y)
    a = np.array([e[0] for e in edges], np.int64)
    return a, np.array([e[1] for e in edges], np.int64)


def joined(meets: DataFrame, former: DataFrame) -> DataFrame:
    """Areas (rep, area) after more meetings; former areas count as one node each, so their inner meetings cost nothing."""
    sides = [former.select(F.col("rep").alias(side), F.col("area").alias(f"{side}_area")) for side in "ab"]
    new = meets.join(sides[0], "a", "left").join(sides[1], "b", "left").select(F.coalesce("a_area", "a").alias("a"), F.coalesce("b_area", "b").alias("b"))
    merged = components(new.filter("a <> b").distinct(), "near-areas")
    first_met = merged.select(F.col("node").alias("rep"), F.col("node").alias("area")).join(former.select("rep"), "rep", "left_anti")
    every = former.unionByName(first_met).join(merged, F.col("area") == F.col("node"), "left")
    return every.select("rep", F.coalesce("label", "area").alias("area"))


def verified(meets: DataFrame, sets: DataFrame, base: DataFrame, text, n: int, threshold: float, target: float) -> DataFrame:
    """Links among representatives: prefixes are shortened until the target recall, and areas that grew are compared again."""
    spark = meets.sparkSession
    depth, before, former, checked = DEPTH, DEPTH + 1, None, None
    while True:
        met = meets.filter((F.col("depth") >= depth) & (F.col("depth") < before))
        if former is None:
            areas = components(met, "near-areas").select(F.col("node").alias("rep"), F.col("label").alias("area"))
        else:
            areas = stored(joined(met, former), "near-areas")
        chosen = areas
        if former is not None:  # what was one area before and still is has been compared
            grown = (
                areas.join(former.withColumnRenamed("area", "was"), "rep", "left").groupBy("area")
                .agg(F.min("was").alias("low"), F.max("was").alias("high"), (F.count("*") - F.count("was")).alias("joined"))
                .filter("joined > 0 or low <> high").select("area")
            )
            chosen = stored(areas.join(grown, "area", "left_semi"), "near-grown")
            checked = checked.join(chosen.select("rep"), F.when(F.col("kind") == PAIRS, F.col("b")).otherwise(F.col("a")) == F.col("rep"), "left_anti")
        chosen = stored(chosen.join(sets.select("rep", "copies", F.shiftright("rep", CHUNK_BITS).alias("chunk")), "rep"), "near-chosen")
        with joins_by_part_of_key(spark):
            texts = base.select("chunk", F.col("rid").alias("rep"), text.alias("text")).join(chosen, ["chunk", "rep"])
            grams = stored(texts.select("rep", "area", "copies", "text").mapInArrow(_sets(n), "rep long, area long, copies long, grams binary"), "near-grams")
        crowd = chosen.groupBy("area").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = grams.join(crowd, "area").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        new = stored(dealt.select("area", "low", "high", "rep", "copies", "grams", "block", "other").groupBy("area", "low", "high").applyInArrow(_check(threshold), CHECKED), "near-checked")
        checked = new if checked is None else checked.unionByName(new)
        found = {r.a: r.pairs for r in checked.filter(F.col("kind") == PAIRS).groupBy("a").agg(F.sum("links").alias("pairs")).collect()}
        further = next_depth(found, depth, threshold, target)  # at most one number per bin came to the driver
        if further == depth:
            return checked.filter(F.col("kind") != PAIRS)
        depth, before, former = further, depth, areas


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, target_recall: float = 0.9999, id_column: str = "doc_id",
    text_column: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """Classes of texts linked by an n-gram Jaccard similarity of at least `threshold`.

    Returns one row per input row: `row` (struct of the carried columns), class_id (least id in the class), n_links (rows it is
    linked to), class_size, kept (one row of each class: least id, null last; of equal ids the least hash of the text; of equal
    texts under one id any). Words are lower-cased in A-Z; a text with fewer than n words is one gram; texts without words, null
    too, are linked to none. Texts with equal sets are linked. Whole texts are read, whatever their length. Every reported link is
    exact; of all links `target_recall` is found, as estimated from the verified ones. An empty table gives no rows.
    """
    spark = docs.sparkSession
    columns, text = row_and_text(docs, carry, text_column)
    base, _ = aligned(docs.select(*columns, quoted(id_column).alias("id")), "near")
    sketches = stored(base.select("rid", "chunk", text.alias("text")).mapInArrow(_sketches(n), SKETCH), "near-sketches")
    keyed = sketches.filter("grams > 0")
    sets = stored(keyed.groupBy("low", "high", "grams").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "near-sets")
    meets = stored(matches(sets, depth_for(threshold, target_recall)), "near-meets")
    checked = verified(meets, sets, base, text, n, threshold, target_recall)
    links = checked.filter(F.col("kind") == COPIES).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(checked.filter(F.col("kind") == EDGE).select("a", "b"), "near-classes").select(F.col("node").alias("rep"), "label")
    grouped = stored(
        sets.select("rep", "copies", "low", "high", "grams").join(links, "rep", "left").join(classes, "rep", "left")
        .select("rep", "copies", "low", "high", "grams", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "rep").alias("label")),
        "near-grouped",
    )
    member = stored(
        keyed.select("rid", "chunk", "low", "high", "grams").join(grouped, ["low", "high", "grams"])
        .select("rid", "chunk", "low", "high", "label", (F.col("copies") - 1 + F.col("links")).alias("n_links")),
        "near-members",
    )
    with joins_by_part_of_key(spark):
        named = stored(
            base.select("chunk", "rid", "id").join(member, ["chunk", "rid"], "left")
            .select("chunk", "rid", "id", "low", "high", F.coalesce("label", "rid").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
            "near-named",
        )
    first = F.min(F.struct(F.col("id").isNull(), "id", "low", "high", "rid"))
    heads = named.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), first["rid"].alias("first"))
    found = named.join(heads, "label").withColumn("kept", F.col("rid") == F.col("first"))
    rows = with_found(base.select("chunk", "rid", "row"), found, ["class_id", "n_links", "class_size", "kept"])
    return rows.select("row", "found.class_id", "found.n_links", "found.class_size", "found.kept")
