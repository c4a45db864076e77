"""Bounded-space online packing of tokenised documents into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A document's tokens that fill whole sequences leave at once; the rest
goes to the open window it fits best. When none fits and all windows are open, the fullest is emitted, topped up with the
head of the piece at hand if its gap is worth a cut. The windows still open at the end of a partition are merged sixteen
partitions at a time by the same packer, until one group is left, whose rest is poured together.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import quoted, ranges

MERGED = 16


#: Bytes of text that are encoded at once.
SLICE = 2 << 20


class WordTokens:
    """Token ids of texts; chunks between blanks that come again are encoded once.

    The tokenizer must drop white space and never join across it. A chunk is kept from its second sight on, as most chunks of a
    corpus come once; a bit per hash value remembers the first. `limit` bounds the bytes of what is kept.
    """

    def __init__(self, path: str, limit: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core; threads of their own only add memory
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.seen = np.zeros(1 << 22, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.reset()

    def reset(self):
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.bytes = 0

    def _learn(self, chunks: list[str]) -> list[str]:
        """Encode new chunks; returns them in the order they are kept in.

        Plain words go many to a text: each ends in exactly one end-of-word token, or is taken alone.
        """
        plain = [c.isalpha() for c in chunks]
        words = list(compress(chunks, plain))
        rest = [c for c, p in zip(chunks, plain, strict=True) if not p]
        names, flat, sizes = [], [], []
        lines = [words[i : i + 128] for i in range(0, len(words), 128)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(line):
                names += line
                flat.append(ids[: ends[-1]])
                sizes.append(np.diff(ends, prepend=0))
            else:
                rest += line
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        names += rest
        flat.append(np.fromiter(chain.from_iterable(alone), np.uint32))
        sizes = np.concatenate([*sizes, np.fromiter(map(len, alone), np.int64, len(alone))]).astype(np.int32)
        flat = np.concatenate(flat)
        first = len(self.known)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(names) > len(self.at):
            self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[first : first + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.length[first : first + len(names)] = sizes
        self.used += len(flat)
        self.known.update(zip(names, range(first, first + len(names)), strict=True))
        return names

    def _keep(self, new: list[str], used: int) -> None:
        """Of the batch's new chunks, keep those seen before; the others only leave their bit."""
        hashes = np.fromiter(map(hash, new), np.int64, len(new)) & (len(self.seen) - 1)
        again = self.seen[hashes]
        self.seen[hashes] = True
        if self.bytes > self.limit:
            again[:] = False
        kept = np.array([self.known[new[i]] for i in np.flatnonzero(again)], np.int64)
        names = [new[i] for i in np.flatnonzero(again)]
        for x in new:
            del self.known[x]
        flat, sizes = self.ids[ranges(self.at[kept], self.length[kept])], self.length[kept]
        first = len(self.known)
        self.ids[used : used + len(flat)] = flat
        self.at[first : first + len(kept)], self.length[first : first + len(kept)] = used + np.cumsum(sizes) - sizes, sizes
        self.used = used + len(flat)
        self.known.update(zip(names, range(first, first + len(names)), strict=True))
        self.bytes += 4 * len(flat) + sum(map(len, names)) + 160 * len(names)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the row offsets in them."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token, whose case would matter
            texts = pc.ascii_lower(texts)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        # A word and one full stop or comma after it are two pieces to the tokenizer.
        cut = pc.match_substring_regex(coded.dictionary, "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]$")
        stems = pc.if_else(cut, pc.utf8_slice_codeunits(coded.dictionary, 0, -1), coded.dictionary).dictionary_encode()
        names = [*stems.dictionary.to_pylist(), ".", ","]
        found = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(found < 0)
        new, used = list(dict.fromkeys(names[i] for i in missing)), self.used
        if new:
            new = self._learn(new)
            found[missing] = [self.known[names[i]] for i in missing]
        stem = found[stems.indices.to_numpy(zero_copy_only=False)]
        marked = cut.to_numpy(zero_copy_only=False).astype(bool)
        comma = pc.ends_with(coded.dictionary, ",").to_numpy(zero_copy_only=False).astype(bool)
        mark = np.where(marked, np.where(comma, found[-1], found[-2]), -1)
        at = coded.indices.to_numpy(zero_copy_only=False)
        both = np.stack([stem[at], mark[at]], axis=1).ravel()
        sizes = np.where(both >= 0, self.length[both], 0)
        both = np.where(both >= 0, both, 0)
        ids = self.ids[ranges(self.at[both], sizes)]
        if new:
            self._keep(new, used)
        offsets = 2 * np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[offsets]


#: One set of known words per worker process, kept from task to task.
_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE bytes of text, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right"))
        stop = min(max(stop, at + 1), batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


class Packer:
    """Pieces are (id, start, doc_tokens, ids); a window is a list of pieces. Finished windows gather in `done`."""

    def __init__(self, size: int, windows: int, cut_gap: int):
        self.size, self.windows, self.cut_gap = size, windows, cut_gap
        self.open: list[tuple[int, int]] = []  # (room, key), ordered by room
        self.held: dict[int, list] = {}
        self.done: list[list] = []
        self.next = 0

    def _keep(self, window: list, room: int) -> None:
        if room == 0:
            self.done.append(window)
        else:
            self.next += 1
            self.held[self.next] = window
            bisect.insort(self.open, (room, self.next))

    def add(self, piece: tuple) -> None:
        doc, start, total, ids = piece
        while len(ids) >= self.size:
            self.done.append([(doc, start, total, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        if len(ids) == 0:
            return
        best = bisect.bisect_left(self.open, (len(ids), 0))
        if best < len(self.open):
            room, key = self.open.pop(best)
            window = self.held.pop(key)
            window.append((doc, start, total, ids))
            self._keep(window, room - len(ids))
            return
        if len(self.open) >= self.windows:
            room, key = self.open.pop(0)
            window = self.held.pop(key)
            if room >= self.cut_gap:
                window.append((doc, start, total, ids[:room]))
                start, ids = start + room, ids[room:]
            self.done.append(window)
        self._keep([(doc, start, total, ids)], self.size - len(ids))

    def rest(self) -> list[list]:
        return [self.held[key] for _, key in self.open]

    def pour(self) -> None:
        """Close all open windows: their pieces fill sequences one after the other, cut where a sequence ends."""
        pieces, self.open, self.held = [p for w in self.rest() for p in w], [], {}
        window, room = [], self.size
        for doc, start, total, ids in pieces:
            while len(ids):
                window.append((doc, start, total, ids[:room]))
                taken = len(window[-1][3])
                start, ids, room = start + taken, ids[taken:], room - taken
                if room == 0:
                    self.done.append(window)
                    window, room = [], self.size
        if window:
            self.done.append(window)


def _rows(packer: Packer, schema: pa.Schema, turn: int, part: int, sequence: int, keep: bool) -> tuple[pa.RecordBatch, int]:
    """The finished windows as rows, and with `keep` one more row that holds the open ones."""
    out: list[tuple] = []
    for window in packer.done:
        at, number = 0, turn << 58 | part << 32 | sequence
        sequence += 1
        for doc, start, total, ids in window:
            out.append((doc, start, len(ids), total, number, at, ids.tobytes(), part, None))
            at += len(ids)
    packer.done = []
    if keep and packer.open:
        left = [{"id": d, "start": s, "total": t, "ids": i.tobytes(), "window": n} for n, w in enumerate(packer.rest()) for d, s, t, i in w]
        out.append((None, None, None, None, None, None, None, part, left))
    columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema), sequence


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, windows: int = 32, cut_gap: int = 16,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of at most `size` tokens.

    Returns per piece: id, start (tokens of its document before it), length, doc_tokens (with the end token), sequence_id,
    offset, ids (little-endian unsigned 32-bit). A null or empty text is its end token alone. Repeated rows are packed each.
    Documents are cut only where they exceed a sequence, or to fill a gap of `cut_gap` tokens or more. An empty table gives no
    rows. `tokenizer` is a path that every executor has. Gaps stay below `cut_gap` tokens, but for the very last sequence.
    """
    kind = docs.schema[id_column].dataType
    piece = T.StructType([
        T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("total", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("window", T.IntegerType()),
    ])
    out = T.StructType(
        [T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset"))]
        + [T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("left", T.ArrayType(piece))]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, packer, part, sequence = word_tokens(tokenizer), Packer(size, windows, cut_gap), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in _slices(whole):
                ids, offsets = tokens.encode(b.column("text"))
                for row, doc in enumerate(b.column("id").to_pylist()):
                    own = np.append(ids[offsets[row] : offsets[row + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    packer.add((doc, 0, len(own), own))
                batch, sequence = _rows(packer, schema, 0, part, sequence, False)
                yield batch
        yield _rows(packer, schema, 0, part, sequence, True)[0]
        pa.default_memory_pool().release_unused()

    def merge(turn: int, last: bool):
        def run(key, states):
            packer = Packer(size, windows, cut_gap)
            for state in sorted(states.to_pylist(), key=lambda r: r["part"]):
                for p in state["left"]:
                    packer.add((p["id"], p["start"], p["total"], np.frombuffer(p["ids"], "<u4")))
            if last:
                packer.pour()
            return pa.Table.from_batches([_rows(packer, schema, turn, key[0].as_py(), 0, not last)[0]])

        return run

    now = stored(docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text")).mapInArrow(online, out), "packing")
    whole, turn = now.filter("left is null"), 0
    while (top := now.filter("left is not null").agg(F.max("part")).first()[0]) is not None:
        turn, last = turn + 1, top < MERGED
        group = F.floor(F.col("part") / MERGED).cast("long")
        now = stored(now.filter("left is not null").select("part", "left", group.alias("g")).groupBy("g").applyInArrow(merge(turn, last), out), "packing-merge")
        whole = whole.unionByName(now.filter("left is null"))
    return whole.drop("part", "left")


