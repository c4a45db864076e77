"""Brown class-based n-gram scores.

Every word gets a class; a text's probability is the product of class transitions and of word emissions within the class. The
classes of frequent words come from exchange clustering: in each round half of the words, by hash, move to the class that
gains most class-bigram likelihood given all other words. Rarer words are classed by the power of two of their count,
which leaves the words seen once, and with them the unknown ones, a class of their own.

Words are counted and classed by owners of hash ranges. A chunk of documents asks each owner once for the counts of its
distinct words; afterwards the texts are token codes, and only classes of the chunk's frequent words travel. The class bigram
table (fixed size) is all that the driver and every task hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import fresh_path, stored
from .common import aligned, hashes, mixed, packed, quoted, words

CLASSES, SINGLE = 32, 32
#: Words are clustered from the count 2**LEAST_BITS on at every size, so the clustered vocabulary grows with the corpus.
LEAST_BITS, MOST_BITS = 3, 48
RARE_CODE = 1 << 31
SHRINK = 10.0


class Layout:
    """Class numbers: clustered classes, one per power of two of rarer counts, the end mark."""

    def __init__(self):
        self.bits = LEAST_BITS
        self.frequent, self.end, self.all = 1 << self.bits, CLASSES + self.bits, CLASSES + self.bits + 1


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordered distinct word hashes of a chunk, the place of each token's word in them, row offsets."""
    codes, offsets, names = words(texts)
    values, places = np.unique(hashes(names), return_inverse=True)
    used = np.zeros(len(values), bool)
    used[places[codes]] = True
    dense = np.cumsum(used) - 1
    return values[used], dense[places[codes]] if len(codes) else codes, offsets


def _owner(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _by_owner(owners: np.ndarray):
    """(owner, start, end) of each run."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(owners)) + 1, [len(owners)]]) if len(owners) else np.zeros(0, np.int64)
    return [(int(owners[s]), int(s), int(e)) for s, e in zip(cut[:-1], cut[1:], strict=True)]


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(text: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(text))


ASK = "owner long, chunk long, hashes binary, counts binary"
ANSWER = "owner long, chunk long, counts binary, hashes binary, tokens long, distinct_words long, singles long, rare array<long>"
SAYS = "i int, j int, n long"


def _ask(bits: int):
    schema = _schema(ASK)

    def run(rows):
        values, places, offsets = _distinct(rows.column("text").combine_chunks())
        train = np.repeat(rows.column("train").to_numpy(), np.diff(offsets))
        counts = np.bincount(places[train], minlength=len(values)) if len(values) else np.zeros(0, np.int64)
        chunk = rows.column("chunk")[0].as_py()
        return _columns([(o, chunk, values[s:e].tobytes(), counts[s:e].astype("<i8").tobytes()) for o, s, e in _by_owner(_owner(values, bits))], schema)

    return run


def _answer():
    """One owner: totals per word, sent back to every chunk that asked; and one row of the owner's own, chunk null."""
    schema = _schema(ANSWER)

    def run(rows):
        rows = rows.sort_by("chunk")
        asked = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("hashes")]
        counts = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in rows.column("counts")])
        values, places = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(places, counts, len(values)).astype(np.int64)
        owner, at, out = rows.column("owner")[0].as_py(), 0, []
        for chunk, own in zip(rows.column("chunk").to_pylist(), asked, strict=True):
            out.append((owner, chunk, totals[places[at : at + len(own)]].astype("<i8").tobytes(), None, None, None, None, None))
            at += len(own)
        often, some = totals >= 1 << LEAST_BITS, totals[totals > 0]
        rare = np.bincount(np.log2(some).astype(np.int64), some, MOST_BITS).astype(np.int64)
        out.append((owner, None, totals[often].astype("<i8").tobytes(), values[often].tobytes(), int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), rare.tolist()))
        return _columns(out, schema)

    return run


def _encode(out: T.StructType, lay: Layout, bits: int, tokens: int, distinct: int, singles: int, rare: list[int], ends: int):
    """Texts of a chunk as token codes, with all that depends on counts alone; and the chunk's frequent words, by owner."""
    schema = to_arrow_schema(out)

    def run(rows, replies):
        values, places, offsets = _distinct(rows.column("text").combine_chunks())
        replies = replies.sort_by("owner") if replies.num_rows else replies
        total = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_py(), "<i8") for x in replies.column("counts")]])
        often = total >= lay.frequent
        bucket = np.log2(np.maximum(total, 1)).astype(np.int64)
        code = np.where(often, np.cumsum(often) - 1, RARE_CODE + SINGLE + np.minimum(bucket, lay.bits - 1)).astype(np.uint32)
        held = np.array([1, *rare[1:]], float)
        emit = np.log10(np.maximum(total, 1)) - np.where(often, 0.0, np.log10(np.maximum(1, held[np.minimum(bucket, lay.bits - 1)])))
        emit = np.where(total == 1, -math.log10(2 * singles + 1), np.where(total == 0, math.log10((singles + 1) / (2 * singles + 1)), emit))
        base = np.log10(total + 1) - math.log10(tokens + distinct + 1)
        n, row = len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        per_row = lambda by_word: np.bincount(row, by_word[places], n) if len(places) else np.zeros(n)
        known = per_row((total > 0).astype(float)).astype(np.int64) + int(ends > 0)
        bases = per_row(base) + math.log10(ends + 1) - math.log10(tokens + distinct + 1)
        codes = code[places] if len(places) else np.zeros(0, np.uint32)
        blobs = [codes[s:e].tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        chunk = rows.column("chunk").combine_chunks()
        texts = pa.table([
            rows.column("row").combine_chunks(), chunk, rows.column("train").combine_chunks(), pa.array(np.diff(offsets) + 1), pa.array(known), pa.array(bases),
            pa.array(per_row(emit)), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()),
        ], schema=schema)
        asked = values[often]
        want = [(None, chunk[0].as_py(), None, None, None, None, None, asked[s:e].tobytes(), o) for o, s, e in _by_owner(_owner(asked, bits))]
        return pa.concat_tables([texts, _columns(want, schema)])

    return run


def _classes_of():
    """One owner: the present classes of the words each chunk asks for."""
    schema = _schema("chunk long, owner long, classes binary")

    def run(asks, state):
        out, values = [], np.frombuffer(state.column("hashes")[0].as_py(), "<u8") if state.num_rows else np.zeros(0, np.uint64)
        classes = np.frombuffer(state.column("classes")[0].as_py(), np.uint8) if state.num_rows else np.zeros(0, np.uint8)
        for chunk, owner, blob in zip(asks.column("chunk").to_pylist(), asks.column("owner").to_pylist(), asks.column("codes"), strict=True):
            out.append((chunk, owner, classes[np.searchsorted(values, np.frombuffer(blob.as_py(), "<u8"))].tobytes()))
        return _columns(out, schema)

    return run


def _tokens(rows: pa.Table, classes: pa.Table, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's texts laid end to end, each closed by the end mark: codes, classes, and the text of each token."""
    held = classes.sort_by("owner").column("classes") if classes.num_rows else []
    by_word = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x.as_py(), np.uint8) for x in held]])
    end = np.array([RARE_CODE + lay.end], np.uint32)
    parts = [p for x in rows.column("codes") for p in (np.frombuffer(x.as_py(), "<u4"), end)]
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    text = np.repeat(np.arange(rows.num_rows), [len(p) + 1 for p in parts[::2]])
    rare = codes >= RARE_CODE
    klass = np.empty(len(codes), np.int64)
    klass[rare] = codes[rare] - RARE_CODE
    klass[~rare] = by_word[codes[~rare]]
    return codes, klass, text


def _before(klass: np.ndarray, lay: Layout) -> np.ndarray:
    """The class before each token. A text starts after an end mark."""
    return np.concatenate([[lay.end], klass[:-1]]) if len(klass) else klass


def _pairs(lay: Layout):
    schema = _schema(SAYS)

    def run(rows, classes):
        _, klass, _ = _tokens(rows, classes, lay)
        table = np.bincount(_before(klass, lay) * lay.all + klass, minlength=lay.all * lay.all)
        some = np.flatnonzero(table)
        return pa.table([pa.array((some // lay.all).astype(np.int32)), pa.array((some % lay.all).astype(np.int32)), pa.array(table[some])], schema=schema)

    return run


def _moves(values: np.ndarray, turn: int) -> np.ndarray:
    """Whether a word may move in this turn."""
    return (mixed(values) >> np.uint64(7)).astype(np.int64) % 2 == turn % 2


CONTEXT = "owner long, hashes binary, sizes binary, sides binary, counts binary"


def _contexts(lay: Layout, bits: int, turn: int):
    """For each frequent word that may move: how often each class stands before it (side = class) and after it (side = all classes + class)."""
    schema = _schema(CONTEXT)

    def run(both, classes):
        asks, rows = both.filter(pa.compute.is_valid(both.column("owner"))), both.filter(pa.compute.is_null(both.column("owner")))
        if not rows.num_rows:
            return _columns([], schema)
        values = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_py(), "<u8") for x in asks.sort_by("owner").column("codes")]])
        codes, klass, _ = _tokens(rows, classes, lay)
        live = codes < RARE_CODE
        live[live] = _moves(values, turn)[codes[live]]
        at = np.flatnonzero(live)
        word = codes[at].astype(np.int64)
        keys = np.concatenate([word * (2 * lay.all) + _before(klass, lay)[at], word * (2 * lay.all) + lay.all + klass[at + 1]])
        keys, counts = np.unique(keys, return_counts=True)
        # One byte a count: a larger one is sent in parts, which the owner adds up.
        parts = -(-counts // 255)
        last = np.cumsum(parts) - 1
        keys, sent = np.repeat(keys, parts), np.full(int(parts.sum()), 255, np.uint8)
        sent[last] = (counts - 255 * (parts - 1)).astype(np.uint8)
        word = keys // (2 * lay.all)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sizes, own = np.diff(np.append(first, len(word))), values[word[first]] if len(first) else values[:0]
        ends, out = np.append(first, len(word)), []
        for o, s, e in _by_owner(_owner(own, bits)):
            lo, hi = ends[s], ends[e]
            out.append((o, own[s:e].tobytes(), sizes[s:e].astype("<u4").tobytes(), (keys[lo:hi] % (2 * lay.all)).astype(np.uint8).tobytes(), sent[lo:hi].tobytes()))
        return _columns(out, schema)

    return run


STATE = "owner long, hashes binary, counts binary, classes binary"


def _exchange(lay: Layout, table: np.ndarray):
    """One owner: each word that may move goes to the class of the highest gain; ties stay, then go to the lowest class."""
    schema = _schema(STATE)
    own_log = lambda x: x * np.log(np.maximum(x, 1e-12))

    def run(rows, state):
        owner, values, counts, classes = (state.column(c)[0].as_py() for c in ("owner", "hashes", "counts", "classes"))
        values, counts, classes = np.frombuffer(values, "<u8"), np.frombuffer(counts, "<i8"), np.frombuffer(classes, np.uint8).copy()
        cells: list[tuple[np.ndarray, np.ndarray]] = []
        for h, z, s, c in zip(*(rows.column(x) for x in ("hashes", "sizes", "sides", "counts")), strict=True):
            word = np.repeat(np.searchsorted(values, np.frombuffer(h.as_py(), "<u8")), np.frombuffer(z.as_py(), "<u4"))
            cells.append((word.astype(np.int64) * (2 * lay.all) + np.frombuffer(s.as_py(), np.uint8), np.frombuffer(c.as_py(), np.uint8).astype(np.int64)))
        if cells:
            keys, places = np.unique(np.concatenate([x[0] for x in cells]), return_inverse=True)
            n = np.bincount(places, np.concatenate([x[1] for x in cells]))
            word = keys // (2 * lay.all)
            movers = np.unique(word)
            totals = table.sum(0).astype(float)
            # Row b of `near`: how often class b has each side, "class before it" then "class after it".
            near = np.concatenate([table.T, table], axis=1).astype(float)[:CLASSES]
            for at in range(0, len(movers), 2048):
                some = movers[at : at + 2048]
                lo, hi = np.searchsorted(word, (some[0], some[-1] + 1))
                w, side, m = np.searchsorted(some, word[lo:hi]), keys[lo:hi] % (2 * lay.all), n[lo:hi].astype(float)
                now, c = classes[some].astype(np.int64), counts[some].astype(float)
                gain = np.empty((CLASSES, len(some)))
                for b in range(CLASSES):
                    here = now[w] == b
                    rest = np.maximum(near[b, side] - np.where(here, m, 0.0), 0.0)
                    size = np.maximum(totals[b] - np.where(now == b, c, 0.0), 0.0)
                    gain[b] = np.bincount(w, own_log(rest + m) - own_log(rest), len(some)) - 2 * (own_log(size + c) - own_log(size))
                best = gain.argmax(0)
                better = gain[best, np.arange(len(some))] > gain[now, np.arange(len(some))] + 1e-9
                classes[some] = np.where(better, best, now)
        return _columns([(owner, values.tobytes(), counts.tobytes(), classes.tobytes())], schema)

    return run


def _score(lay: Layout, out: T.StructType, table: np.ndarray):
    schema = to_arrow_schema(out)
    totals, seen = table.sum(0).astype(float), float(table.sum())
    prior = (totals + 1) / (seen + lay.all)
    step = np.log10((table + SHRINK * prior[None, :]) / (table.sum(1, keepdims=True) + SHRINK))
    step[:, :CLASSES] -= np.log10(np.maximum(totals[:CLASSES], 1))[None, :]  # the class part of a frequent word's emission

    def run(rows, classes):
        _, klass, text = _tokens(rows, classes, lay)
        gained = np.bincount(text, step[_before(klass, lay), klass], rows.num_rows)
        cols = [rows.column(c).combine_chunks() for c in ("row", "train", "n_tokens", "n_known", "base_score")]
        return pa.table([*cols, pa.array(gained + rows.column("emit").to_numpy())], schema=schema)

    return run


def class_ngram_scores(
    docs: DataFrame, train: Column, text_column: str = "text", carry: list[str] | None = None, rounds: int = 4, docs_per_owner: int = 8192,
) -> tuple[DataFrame, dict]:
    """log10 probability of every text under class bigrams learned from the rows where `train` holds; and the totals.

    Rows: `row` (struct of the carried columns), train, n_tokens (words and one end), n_known, base_score (add-one unigram),
    score. Totals: tokens and distinct_words of the training rows. Words are lower-cased in A-Z and told apart by 64-bit
    hashes. All unknown words count as one word, as in the base. A null or empty text is its end alone. Repeated rows count each.
    Without training rows every word is unknown. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base, n_rows = aligned(docs.select(packed(docs, carry).alias("row"), F.coalesce(train, F.lit(False)).alias("train"), quoted(text_column).alias("text")), "brown")
    bits = max(4, math.ceil(math.log2(max(1, n_rows / docs_per_owner))))
    answers = stored(
        base.select("chunk", "train", "text").groupBy("chunk").applyInArrow(_ask(bits), ASK).groupBy("owner").applyInArrow(_answer(), ANSWER), "brown-counts"
    )
    own = answers.filter("chunk is null")
    got = own.agg(
        F.sum("tokens").alias("tokens"), F.sum("distinct_words").alias("distinct_words"), F.sum("singles").alias("singles"),
        *[F.sum(F.col("rare")[i]).alias(f"r{i}") for i in range(MOST_BITS)],
    ).first()
    ends = base.filter("train").count()
    tokens, distinct = (got["tokens"] or 0) + ends, (got["distinct_words"] or 0) + int(ends > 0)
    lay = Layout()
    rare = [got[f"r{i}"] or 0 for i in range(lay.bits)]

    given = base.schema["row"]
    coded = T.StructType([given, *T._parse_datatype_string("chunk long, train boolean, n_tokens long, n_known long, base_score double, emit double, codes binary, owner long").fields])
    replies = answers.filter("chunk is not null").select("chunk", "owner", "counts")
    both = base.select("row", "chunk", "train", "text").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_encode(coded, lay, bits, tokens, distinct, got["singles"] or 0, rare, ends), coded)
    path = fresh_path(spark, "brown-coded")
    name = "brown_coded_" + path.rsplit("-", 1)[-1]
    buckets = int(min(50_000, max(8, math.ceil(n_rows / 8192))))
    both.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    texts, wanted = spark.table(name).filter("owner is null"), stored(spark.table(name).filter("owner is not null").select("chunk", "owner", "codes"), "brown-wanted")
    learn = texts.filter("train").select("chunk", "codes")
    asking = spark.table(name).filter("train or owner is not null").select("chunk", "owner", "codes")  # bucketed by chunk: hashes do not move again

    # Words start in the class of their hash.
    first = _first_classes(lay)
    state = stored(own.select("owner", "hashes", "counts").mapInArrow(first, STATE), "brown-classes")

    def classes_by_chunk(now: DataFrame) -> DataFrame:
        return stored(wanted.groupBy("owner").cogroup(now.groupBy("owner")).applyInArrow(_classes_of(), "chunk long, owner long, classes binary"), "brown-held")

    def pair_table(held: DataFrame) -> np.ndarray:
        table = np.zeros((lay.all, lay.all))
        for i, j, n in learn.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(_pairs(lay), SAYS).groupBy("i", "j").agg(F.sum("n")).collect():
            table[i, j] = n
        return table

    for turn in range(rounds):
        held = classes_by_chunk(state)
        table = pair_table(held)
        seen = asking.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(_contexts(lay, bits, turn), CONTEXT)
        state = stored(seen.groupBy("owner").cogroup(state.groupBy("owner")).applyInArrow(_exchange(lay, table), STATE), "brown-classes")
    held = classes_by_chunk(state)
    table = pair_table(held)
    out = T.StructType([given, *T._parse_datatype_string("train boolean, n_tokens long, n_known long, base_score double, score double").fields])
    scored = texts.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(_score(lay, out, table), out)
    return scored, {"tokens": tokens, "distinct_words": distinct}


def _first_classes(lay: Layout):
    schema = _schema(STATE)

    def run(batches):
        for b in batches:
            rows = []
            for o, h, c in zip(*(b.column(x).to_pylist() for x in ("owner", "hashes", "counts")), strict=True):
                values, counts = np.frombuffer(h, "<u8"), np.frombuffer(c, "<i8")
                values, counts = values[counts >= lay.frequent], counts[counts >= lay.frequent]
                rows.append((o, values.tobytes(), counts.tobytes(), (mixed(values) % np.uint64(CLASSES)).astype(np.uint8).tobytes()))
            yield from _columns(rows, schema).to_batches()

    return run
