"""How far the sources of a language differ in their use of terms.

Strings are materialised late. Tasks count the terms of their texts by 64-bit digests, and every shuffle of counts moves digests
alone. A second pass over the texts spells out the digests that are kept, each once per batch. The strings of kept digests are read once for their minimum and maximum: where these differ,
two terms share a digest, and only such digests are counted again by string. Strings come back for the reported terms only.

Summed differences of all pairs of sources come from tiles: blocks of terms by blocks of sources. A tile sums its terms for all
its pairs at once, so a term that every source uses costs one row per source, never one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import quoted

SCALE = 1_000_000_000
ADDED = 5
#: Letters keep, A-Z become small, all other ASCII ends a term; bytes of other characters keep.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every term of a batch, and the distinct terms by code (binary)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(texts.buffers()[2][offsets[0] : offsets[-1]].to_pybytes().translate(_LETTERS), np.uint8)
    offsets = offsets - offsets[0]
    inside = letters != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(letters)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(offsets, starts, "right") - 1
    kept = letters[inside]
    bounds = np.append((np.cumsum(inside) - 1)[starts], len(kept)).astype(np.int64)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    coded = spelled.dictionary_encode()
    return rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _digests(names: pa.Array, bits: int) -> np.ndarray:
    """Hashes of terms (binary), the same in every process."""
    if not len(names):
        return np.zeros(0, np.int64)
    return (pd.util.hash_array(np.array(names.to_pylist(), dtype=object), categorize=False) >> np.uint64(64 - bits)).astype(np.int64)


def _strings(names: pa.Array) -> pa.Array:
    return names.cast(pa.large_string(), safe=False).cast(pa.string())


def _count(batch: pa.Table, bits: int) -> pa.RecordBatch:
    """Occurrences, and rows with the term, per group and term of a batch: l, g, d, n, docs, term."""
    languages, groups = (batch.column(c).to_numpy() for c in ("l", "g"))
    rows, codes, names = _terms(batch.column("text").combine_chunks())
    own, at, place = np.unique(groups, return_index=True, return_inverse=True)
    width = max(1, len(names))
    once, times = np.unique((place[rows] * width + codes) * batch.num_rows + rows, return_counts=True)
    cells = once // batch.num_rows
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    n = np.add.reduceat(times, starts) if len(starts) else np.zeros(0, np.int64)
    docs = np.diff(np.append(starts, len(cells)))
    group, code = cells[starts] // width, cells[starts] % width
    columns = {"l": languages[at][group], "g": own[group], "d": _digests(names, bits)[code], "n": n, "docs": docs}
    found = {c: pa.array(v, pa.int64()) for c, v in columns.items()} | {"term": _strings(names.take(pa.array(code)))}
    return pa.RecordBatch.from_pydict(found)


def _spell(batch: pa.Table, bits: int) -> pa.RecordBatch:
    """The distinct terms of a batch: d, term."""
    _, _, names = _terms(batch.column("text").combine_chunks())
    return pa.RecordBatch.from_pydict({"d": pa.array(_digests(names, bits), pa.int64()), "term": _strings(names)})


def _gathered(work, columns: list[str], size: int):
    """Runs `work` on batches of about `size` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                bytes_held += held[-1].column("text").nbytes
                if bytes_held >= size:
                    yield work(pa.Table.from_batches(held)).select(columns)
                    held, bytes_held = [], 0
        if held:
            yield work(pa.Table.from_batches(held)).select(columns)

    return run


def _digested(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, texts): the languages and sources with digests l and g that were checked to tell them apart."""
    slim = docs.select(*[F.coalesce(quoted(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = stored(slim.select("lang", "source").distinct(), "divergence-groups")
    seed = 0
    while True:
        l, g = F.xxhash64(F.lit(seed), "lang"), F.xxhash64(F.lit(seed), "lang", F.lit("source"), "source")
        groups = names.select("lang", "source", l.alias("l"), g.alias("g"))
        wrong = [
            groups.select("lang", "source", "l", "g").groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"),
            groups.groupBy("l").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).filter("a <> b"),
        ]
        if all(w.isEmpty() for w in wrong):
            return groups, slim.select(l.alias("l"), g.alias("g"), "text")
        seed += 1


def _scaled(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), in decimals; 1 without terms."""
    count, total, terms = (F.col(c) if isinstance(c, str) else c for c in (count, total, terms))
    above, below = (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + ADDED * terms).cast("decimal(20,0)")
    rest = F.pmod(above, below)
    return F.when(terms > 0, ((above - rest) / below).cast("long")).otherwise(0) + 1


def _kept(counted: DataFrame, keys: list[str], least_docs: int) -> DataFrame:
    """Counts per group of the terms that enough documents of a language hold: l, g, *keys, n, all_n (in the language)."""
    per_group = stored(counted.groupBy("l", "g", *keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    frequent = per_group.groupBy("l", *keys).agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).filter(F.col("docs") >= least_docs)
    return per_group.drop("docs").join(frequent.drop("docs"), ["l", *keys])


def kept_terms(texts: DataFrame, least_docs: int, bits: int = 63, gathered: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """(counts, names): l, g, d, part, n, all_n of kept terms; the string of each (d, part). `part` tells terms of one digest apart.

    A task counts about `gathered` bytes of text together.
    """
    def counted(names: list[str], schema: str) -> DataFrame:
        return texts.mapInArrow(_gathered(lambda batch: _count(batch, bits), names, gathered), schema)

    plain = stored(_kept(counted(["l", "g", "d", "n", "docs"], "l long, g long, d long, n long, docs long"), ["d"], least_docs), "divergence-kept")
    spelled = texts.mapInArrow(_gathered(lambda batch: _spell(batch, bits), ["d", "term"], gathered), "d long, term string")
    # Distinct strings first: nearly always one per digest is left to take the minimum and maximum of.
    distinct = spelled.join(plain.select("d").distinct(), "d", "left_semi").distinct()
    names = stored(distinct.groupBy("d").agg(F.min("term").alias("term"), F.max("term").alias("last")), "divergence-names")
    shared = names.filter("term <> last").select("d")
    zero = F.lit("")
    if shared.isEmpty():
        return plain.withColumn("part", zero), names.select("d", zero.alias("part"), "term")
    shared = stored(shared, "divergence-shared")
    again = counted(["l", "g", "d", "n", "docs", "term"], "l long, g long, d long, n long, docs long, term string").join(shared, "d", "left_semi")
    apart = _kept(again, ["d", "term"], least_docs).withColumnRenamed("term", "part")
    counts = plain.join(shared, "d", "left_anti").withColumn("part", zero).unionByName(apart)
    told = apart.select("d", "part").distinct().withColumn("term", F.col("part"))
    return stored(counts, "divergence-kept"), names.join(shared, "d", "left_anti").select("d", zero.alias("part"), "term").unionByName(told)


def _tile(source_block: int):
    """Summed differences over the terms of a tile, for each pair of its sources (of one block, or of two).

    Each term counts by how much it differs from a term that neither source has, so terms outside the tile add nothing.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        language, _, low, high = (k.as_py() for k in key)
        right = right.sort_by("no")
        number, none = right.column("no").to_numpy(), right.column("p0").to_numpy()
        named = pd.MultiIndex.from_arrays([left.column("d").to_pandas(), left.column("part").to_pandas()])
        term = pd.factorize(named)[0] if left.num_rows else np.zeros(0, np.int64)
        values = np.repeat(none[:, None], int(term.max()) + 1 if len(term) else 0, axis=1)
        values[np.searchsorted(number, left.column("source_no").to_numpy()), term] = left.column("p").to_numpy()
        first, second = (np.flatnonzero(number // source_block == block) for block in (low, high))
        a, b, f = [[np.zeros(0, np.int64)] for _ in range(3)]
        for i in first:
            others = second[second > i]
            a.append(np.full(len(others), number[i]))
            b.append(number[others])
            f.append(np.abs(values[others] - values[i]).sum(axis=1) - values.shape[1] * np.abs(none[others] - none[i]))
        a, b, f = (np.concatenate(x) for x in (a, b, f))
        return pa.table({n: pa.array(x, pa.int64()) for n, x in (("l", np.full(len(a), language)), ("a", a), ("b", b), ("f", f))})

    return run


def _pairs(counts: DataFrame, groups: DataFrame, term_block: int, source_block: int) -> DataFrame:
    """(g, item, value) for every ordered pair of sources of a language."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block)).cast("long")
    in_language = Window.partitionBy("l")
    placed = stored(
        groups.withColumn("source_no", F.row_number().over(in_language.orderBy("source")) - 1).withColumn("sources", F.count("*").over(in_language))
        .withColumn("p0", _scaled(F.lit(0), "total", "terms")).withColumn("term_blocks", blocks),
        "divergence-sources",
    )
    own = F.floor(F.col("source_no") / source_block).cast("long")
    every = F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / source_block).cast("long"))
    tiles = F.explode(F.transform(every, lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high"))))
    key = ["l", "term_block", "low", "high"]
    named = counts.join(placed.select("l", "g", "source_no", "sources", "term_blocks", "total", "terms"), ["l", "g"])
    left = (
        named.withColumn("term_block", F.pmod(F.xxhash64("d", "part"), "term_blocks")).withColumn("p", _scaled("n", "total", "terms"))
        .withColumn("tile", tiles).select("l", "term_block", "tile.low", "tile.high", "source_no", "d", "part", "p")
    )
    right = (
        placed.withColumn("term_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))).withColumn("tile", tiles)
        .select("l", "term_block", "tile.low", "tile.high", F.col("source_no").alias("no"), "p0")
    )
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(source_block), "l long, a long, b long, f long")
    summed = stored(found.groupBy("l", "a", "b").agg(F.sum("f").alias("value")), "divergence-pairs")
    both = summed.select("l", F.col("a").alias("source_no"), F.col("b").alias("other"), "value").unionByName(
        summed.select("l", F.col("b").alias("source_no"), F.col("a").alias("other"), "value")
    )
    other = placed.select("l", F.col("source_no").alias("other"), F.col("source").alias("item"), F.col("p0").alias("other_p0"))
    joined = both.join(placed.select("l", "source_no", "g", "p0", "terms"), ["l", "source_no"]).join(other, ["l", "other"])
    return joined.select("g", "item", (F.col("value") + F.col("terms") * F.abs(F.col("p0") - F.col("other_p0"))).alias("value"))


def source_divergence(
    docs: DataFrame, least_docs: int = 30, report: int = 50, bits: int = 63, term_block: int = 2048, source_block: int = 128, gathered: int = 8 << 20,
) -> DataFrame:
    """Per language and source: its distance to each other source of the language, and its most overused terms.

    Terms are runs of letters (ASCII, and every other character), A-Z in small letters; a language keeps those in at least
    `least_docs` of its documents. With V kept terms, a share is p = 1 + floor(10^9 (count + 5) / (N + 5 V)). Returns lang, source, part, item,
    value, rank: part 'pair' has each other source and the differences of shares summed over all kept terms; part 'term' the `report`
    terms by how far the share in the source exceeds that in the language. Ranks go by value, then item in UTF-8 order.

    Null lang, source and text count as empty. Repeated rows are documents each. Sources without terms have count 0
    everywhere. A language without kept terms has distances 0; one with a single source has none. Long texts are counted
    whole. An empty table gives no rows. `bits` is the digest's length; a tile holds about `term_block` terms of twice `source_block` sources.
    """
    groups, texts = _digested(docs)
    counts, names = kept_terms(texts, least_docs, bits, gathered)
    totals = counts.groupBy("l", "g").agg(F.sum("n").alias("total"))
    languages = counts.select("l", "d", "part", "all_n").distinct().groupBy("l").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    sized = stored(
        groups.join(totals, ["l", "g"], "left").join(languages, "l", "left").na.fill(0, ["total", "terms", "all_total"]), "divergence-sized"
    )
    pairs = _pairs(counts, sized.select("l", "g", "source", "total", "terms"), term_block, source_block)
    shares = counts.join(sized.select("l", "g", "total", "terms", "all_total"), ["l", "g"]).withColumn("value", _scaled("n", "total", "terms") - _scaled("all_n", "all_total", "terms"))
    best = Window.partitionBy("g").orderBy(F.col("value").desc())
    # Ties at the last rank stay until their strings decide.
    leading = shares.filter("value > 0").select("g", "d", "part", "value").withColumn("near", F.rank().over(best)).filter(F.col("near") <= report)
    terms = leading.join(names, ["d", "part"]).select("g", F.col("term").alias("item"), "value")
    order = Window.partitionBy("g").orderBy(F.col("value").desc(), "item")
    ranked = [
        df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= last if last else F.lit(True)).withColumn("part", F.lit(part))
        for df, part, last in ((pairs, "pair", 0), (terms, "term", report))
    ]
    return ranked[0].unionByName(ranked[1]).join(groups.select("g", "lang", "source"), "g").select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
