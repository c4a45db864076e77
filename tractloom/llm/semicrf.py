"""Personal data by a semi-Markov conditional random field over candidate segments.

Four patterns give the base spans, which always stay. The model reads a text as tokens; a segment is an entity of one of the
four types, at most MAX_TOKENS tokens long (MAX_ALL with blanks and brackets, MAX_CHARS characters), or a single outside token. Whole-span
features (shape, digit count, length, checks, the one character on each side, type) score a segment; dynamic programming over bounded
segments chooses boundaries and types together. Weights maximise the conditional likelihood of the base spans of training texts (forward and
backward sums over all readings, adaptive gradient steps), shown as they stand and in altered writing (plus sign dropped, at-signs and dots in brackets, digits grouped), so that the model can add what
patterns miss. Stretches with a span over the bound take no part in the fit: as outside text they would teach the opposite.

Outside tokens score zero and take no part in any feature of segments further off, so the programme runs on stretches
around tokens that can open or close an entity; the rest of a text is outside whatever its length.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 32
#: Bounds of a segment with blanks and brackets, and of the digits of one without an at-sign (a card has 19 at most).
MAX_ALL, MAX_CHARS, MAX_DIGITS = 96, 192, 19
FEATURES = 1 << 14
#: How far the best entity reading must beat the reading without it before a span is added.
MARGIN = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|[^\S\n]+|\n")
_AT = re.compile(r"@|\[at\]|\(at\)", re.IGNORECASE)
_ANCHOR = re.compile(r"[0-9@]|\[at\]|\(at\)", re.IGNORECASE)
_GAP = re.compile(r"[A-Za-z0-9]\s+(?=[A-Za-z0-9])")
_BRACKETS = "[](){}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost e-mail matches, found from their at-sign: a local part runs back to the last match or a foreign character."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _shape(text: str) -> str:
    """Runs of digits as d with their length, of letters as a, other characters as they are."""
    return re.sub(r"[0-9]+|[A-Za-z]+", lambda m: f"d{min(len(m[0]), 20)}" if m[0][0].isdigit() else "a", text)[:40]


def _slot(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


@lru_cache(1 << 17)
def _slots(fact: tuple) -> list[int]:
    return [_slot(k, *fact) for k in range(len(KINDS))]


class Spans:
    """Features of whole spans; repeated ones are hashed once. A span is known by its row in `table` (kind, slots that fire)."""

    WIDTH = 13

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.written: dict[tuple, int] = {}
        self.table = np.zeros((1024, len(KINDS), self.WIDTH), np.uint16)

    def row(self, text: str, start: int, end: int, before: str, after: str) -> int:
        span = text[start:end]
        written = (span, before, after)
        if written not in self.written:
            if len(self.written) > 200_000:
                self.written.clear()
            self.written[written] = self._row(span, before, after)
        return self.written[written]

    def _row(self, span: str, before: str, after: str) -> int:
        digits = "".join(c for c in span if c in "0123456789")
        shape = _shape(span)
        coarse = re.sub(r"d[0-9]+", "d", shape)
        octets = [o.strip(" []") for o in span.split(".")]
        facts = (
            ("shape", shape), ("coarse", coarse), ("digits", len(digits)), ("luhn", 16 <= len(digits) <= 19 and luhn(digits)),
            ("octets", len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) < 4 and int(o) <= 255 for o in octets)),
            ("at", len(_AT.findall(span)), "." in span), ("plus", span[:1] == "+"),
            ("ends", span[:1].isalnum(), span[-1:].isalnum()), ("before", before[-1:] if before[-1:] and not before[-1:].isalnum() else "w" * bool(before)),
            ("after", after[:1] if after[:1] and not after[:1].isalnum() else "w" * bool(after)), ("any",), ("letters", any(c.isalpha() for c in span), bool(digits)),
            ("gaps", len(_GAP.findall(span))),
        )
        if facts not in self.known:
            at = len(self.known)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = np.array([_slots(f) for f in facts]).T
            self.known[facts] = at
        return self.known[facts]


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Tokens near a possible entity, as runs of (start, end); runs do not reach over a line end."""
    out: list[list[tuple[int, int]]] = []
    last = -1
    reach = 80
    for m in _ANCHOR.finditer(text):
        if m.start() < last:
            continue
        lo = max(text.rfind("\n", 0, m.start()) + 1, m.start() - reach, last, 0)
        hi = m.end()
        while True:  # as long as the next anchor is near
            nxt = _ANCHOR.search(text, hi, min(len(text), hi + reach))
            if not nxt or "\n" in text[hi : nxt.start()]:
                break
            hi = nxt.end()
        stop = text.find("\n", hi, hi + reach)
        hi = stop if stop >= 0 else min(len(text), hi + reach)
        tokens = [(t.start(), t.end()) for t in _TOKEN.finditer(text, lo, hi)]
        if tokens:
            out.append(tokens)
        last = hi
    return out


def _counted(text: str, tokens: list[tuple[int, int]]) -> list[bool]:
    return [not text[s].isspace() and text[s] not in _BRACKETS for s, _ in tokens]


def segment_blocks(text: str, tokens: list[tuple[int, int]], spans: Spans, block: int = 512):
    """Segments (first token, end token, start, end, row of its features) of bounded length, no blank at the ends.

    They come in order of their first token, `block` of these at a time, so a line of any length needs little memory. A
    segment holds a digit or one at-sign, which may be written [at] or (at); letters only with an at-sign, since only addresses
    have them; without one MAX_DIGITS digits at most.
    """
    blank = [text[s].isspace() for s, _ in tokens]
    counted = _counted(text, tokens)
    letters = [text[s].isalpha() for s, _ in tokens]
    written = {m.start() + 1 for m in _AT.finditer(text, tokens[0][0], tokens[-1][1]) if m.end() > m.start() + 1}
    signs = [text[s] == "@" or s in written for s, _ in tokens]
    numbers = [e - s if text[s].isdigit() else 0 for s, e in tokens]
    ahead = np.append(np.where(signs, np.arange(len(tokens)), len(tokens)), len(tokens))
    ahead = np.minimum.accumulate(ahead[::-1])[::-1].tolist()  # the next sign from here on
    for low in range(0, len(tokens), block):
        out = []
        for i in range(low, min(low + block, len(tokens))):
            if blank[i]:
                continue
            s = tokens[i][0]
            has_letter = False
            has_sign = size = digits = 0
            for j in range(i, min(i + MAX_ALL, len(tokens))):
                size += counted[j]
                digits += numbers[j]
                has_letter, has_sign = has_letter or letters[j], has_sign + signs[j]
                e = tokens[j][1]
                if size > MAX_TOKENS or e - s > MAX_CHARS or has_sign > 1:
                    break
                if not has_sign and (has_letter or digits > MAX_DIGITS) and ahead[j] - i >= MAX_ALL:
                    break
                if not blank[j] and (has_sign or 0 < digits <= MAX_DIGITS and not has_letter):
                    out.append((i, j + 1, s, e, spans.row(text, s, e, text[max(0, s - 1) : s], text[e : e + 1])))
        yield np.array(out, np.int64).reshape(-1, 5)


def candidates(text: str, tokens: list[tuple[int, int]], spans: Spans) -> np.ndarray:
    """All segments of a stretch."""
    return np.concatenate([np.zeros((0, 5), np.int64), *segment_blocks(text, tokens, spans)])


def decode(n: int, blocks, spans: Spans, weights: np.ndarray) -> list[tuple]:
    """The best reading of n tokens: [(kind, start, end, score, slots)]. `blocks` are segments in order of their first token."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    done = 0

    def outside(upto: int) -> None:
        nonlocal done
        for at in range(done, upto):  # a token outside, unless an entity ending behind it is better
            if best[at] >= best[at + 1]:
                best[at + 1], back[at + 1] = best[at], None
        done = max(done, upto)

    for segments in blocks:
        scores = weights[spans.table[segments[:, 4]]].sum(2)
        kinds, most = scores.argmax(1), scores.max(1)
        some = np.flatnonzero(most > 0)
        for (i, j, s, e, row), k, own in zip(segments[some].tolist(), kinds[some].tolist(), most[some].tolist(), strict=True):
            outside(i)
            if best[i] + own > best[j]:
                best[j], back[j] = best[i] + own, (i, k, s, e, own, row)
    outside(n)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k, s, e, own, row = back[j]
            out.append((k, s, e, own, spans.table[row, k]))
            j = i
    return out[::-1]


def _altered(kind: int, span: str, turn: random.Random) -> str:
    """Another writing of the same datum."""
    if kind == 0:
        local, domain = span.split("@", 1)
        return turn.choice([f"{local} @ {domain}", f"{local}[at]{domain}", f"{local}(at){domain}"])
    if kind == 1:
        return turn.choice([span.replace(".", " . "), span.replace(".", "[.]")])
    if kind == 2:
        digits = "".join(c for c in span if c.isdigit())
        return turn.choice([".", " - ", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return turn.choice([span.replace("+", "00", 1), span.replace(" ", "/"), span.replace("+", "+ ", 1)])


def _fits(text: str, tokens: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span begins and ends with tokens of this stretch and keeps to the bound."""
    inside = [t for t in tokens if start <= t[0] and t[1] <= end]
    if not inside or inside[0][0] != start or inside[-1][1] != end or len(inside) > MAX_ALL or end - start > MAX_CHARS:
        return False
    signs = len(_AT.findall(text, start, end))
    return (signs == 1 or not signs and sum(c.isdigit() for c in text[start:end]) <= MAX_DIGITS) and sum(_counted(text, inside)) <= MAX_TOKENS


class Batch:
    """Stretches of similar length whose readings are summed together, token by token."""

    def __init__(self, cases: list[tuple]):
        parts = [np.column_stack([np.full(len(segments), c), segments[:, [0, 1, 4]]]) for c, (_, segments, _) in enumerate(cases)]
        of, start, end, row = np.concatenate(parts).T
        order = np.lexsort((end, of, start))
        self.of, self.start, self.end = of[order], start[order], end[order]
        self.rows, self.place = np.unique(row[order], return_inverse=True)
        self.length, self.count = max(n for n, _, _ in cases), len(cases)
        self.cuts = np.searchsorted(self.start, np.arange(self.length + 1))
        true = np.array([at for _, _, mine in cases for at in mine.values()], np.int64).reshape(-1, 2)
        self.truth = np.searchsorted(self.rows, true[:, 0]), true[:, 1]

    def chances(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the scores of each segment by kind: log of the sum over all readings per stretch, and each segment's probability."""
        either = np.logaddexp.reduce(scores, 1)
        upto = np.full((self.count, self.length + 1), -np.inf)
        after = np.zeros((self.count, self.length + 1))
        upto[:, 0] = 0
        for t in range(self.length):
            upto[:, t + 1] = np.logaddexp(upto[:, t + 1], upto[:, t])
            own = slice(self.cuts[t], self.cuts[t + 1])
            c, e = self.of[own], self.end[own]  # no two segments of a stretch share both ends
            upto[c, e] = np.logaddexp(upto[c, e], upto[c, t] + either[own])
        for t in range(self.length - 1, -1, -1):
            after[:, t] = after[:, t + 1]
            own = slice(self.cuts[t], self.cuts[t + 1])
            c = self.of[own]
            if len(c):
                first = np.flatnonzero(np.diff(c, prepend=-1))
                more = np.logaddexp.reduceat(after[c, self.end[own]] + either[own], first)
                after[c[first], t] = np.logaddexp(after[c[first], t], more)
        total = upto[:, -1]
        around = upto[self.of, self.start] + after[self.of, self.end] - total[self.of]
        return total, np.exp(around[:, None] + scores)

    def gradient(self, weights: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the log-likelihood of the true readings, and that likelihood."""
        slots = table[self.rows]
        by_row = weights[slots].sum(2)
        total, chance = self.chances(by_row[self.place])
        pull = -np.column_stack([np.bincount(self.place, chance[:, k], len(self.rows)) for k in range(len(KINDS))])
        np.add.at(pull, self.truth, 1)
        slope = np.bincount(slots.ravel(), np.repeat(pull.ravel(), slots.shape[2]), FEATURES)
        return slope, float(by_row[self.truth].sum() - total.sum())


def batches(cases: list[tuple], most: int = 100_000) -> list[Batch]:
    """Batches of up to 64 stretches and about `most` segments, from the shortest stretch to the longest."""
    out, held, size = [], [], 0
    for case in sorted(cases, key=lambda x: x[0]):
        if held and (len(held) == 64 or size + len(case[1]) > most):
            out.append(Batch(held))
            held, size = [], 0
        held.append(case)
        size += len(case[1])
    return [*out, Batch(held)] if held else out


def fit(texts: list[str], passes: int = 12, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
    """Weights under which the base spans of the texts are the likeliest readings, less `decay` / 2 times their square.

    Steps follow the gradient, each weight at its own pace (`rate` over the root of its summed squares). Weights start at -0.1, so
    features never seen speak against a span; without any span nothing is added.
    """
    turn, spans = random.Random(7), Spans()
    cases = []

    def learn_from(text, truth):
        for tokens in stretches(text):
            segments = candidates(text, tokens, spans)
            known = {(s, e): row for _, _, s, e, row in segments.tolist()}
            near = [x for x in truth if x[1] < tokens[-1][1] and x[2] > tokens[0][0]]
            lost = [x for x in near if x[1:] not in known]
            for k, s, e in lost:
                if _fits(text, tokens, s, e):
                    raise ValueError(f"a span of kind {KINDS[k]} written like {_shape(text[s:e])} is no candidate")
            if len(segments) and not lost:
                cases.append((len(tokens), segments, {(k, s, e): (known[s, e], k) for k, s, e in near}))

    for text in texts:
        truth = _disjoint(base_spans(text))
        learn_from(text, truth)
        if truth:
            parts, at, moved, shift = [], 0, [], 0
            for k, s, e in truth:
                new = _altered(k, text[s:e], turn)
                parts += [text[at:s], new]
                moved.append((k, s + shift, s + shift + len(new)))
                shift += len(new) - (e - s)
                at = e
            learn_from("".join([*parts, text[at:]]), moved)
    todo = batches(cases)
    weights, paces = np.full(FEATURES, -0.1), np.full(FEATURES, 1e-2)
    for _ in range(passes):
        turn.shuffle(todo)
        for batch in todo:
            slope = batch.gradient(weights, spans.table)[0] - decay * weights
            paces += slope * slope
            weights += rate * slope / np.sqrt(paces)
    return weights


def _disjoint(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if not out or s >= out[-1][2]:
            out.append((k, s, e))
    return out


def find(text: str, weights: np.ndarray, spans: Spans) -> tuple[list, list]:
    """Base spans, and the spans the model adds: those that overlap no base span and win by MARGIN."""
    if not _ANCHOR.search(text):
        return [], []
    base = base_spans(text)
    held = sorted((s, e) for _, s, e in base)
    added = []
    if len(spans.known) > 100_000:
        spans.__init__()
    for tokens in stretches(text):
        for k, s, e, score, _ in decode(len(tokens), segment_blocks(text, tokens, spans), spans, weights):
            if score >= MARGIN and not any(s < b and a < e for a, b in held):
                added.append((k, s, e))
    return base, added


def train(docs: DataFrame, max_rows: int = 2000, id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """Weights from at most max_rows texts with a digit or an at-sign, those first by a hash of their id and text."""
    eligible = docs.select(F.xxhash64(quoted(id_column).cast("string"), quoted(text_column)).alias("h"), quoted(text_column).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    # Hashes alone are sorted; texts are fetched for those drawn. Rows that share a hash are one text, taken as often as drawn.
    drawn = eligible.select("h").orderBy("h").limit(max_rows).groupBy("h").agg(F.count("*").alias("times"))
    once = eligible.join(F.broadcast(drawn), "h").groupBy("h").agg(F.min("text").alias("text"), F.max("times").alias("times"))
    sample = once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("text", "h", F.lit(0).alias("g"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"w": [fit(rows.sort_values("h")["text"].tolist()).astype("<f8").tobytes()]})

    found = sample.groupBy("g").applyInPandas(run, "w binary").collect()
    return np.frombuffer(found[0][0], "<f8") if found else np.full(FEATURES, -1.0)


FOUND = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def personal_data(docs: DataFrame, weights: np.ndarray, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Personal data of every text: `row` (struct of the carried columns) and found, by kind, then start (code points).

    Base spans come from the patterns, the others from the model. Whole texts are read. Null and empty texts have none. Repeated
    rows are searched each; an empty table gives no rows.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    given = docs.select(packed(docs, carry).alias("row"), quoted(text_column).alias("text"))
    out = T.StructType([given.schema["row"], T.StructField("found", T._parse_datatype_string(FOUND))])
    schema, held = to_arrow_schema(out), docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        spans = Spans()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b, rows = whole.slice(at, 1024), []
                for text in b.column("text"):
                    base, added = find(text.as_py() or "", held.value, spans)
                    both = sorted([(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in added], key=lambda x: x[:3])
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": known} for k, s, e, known in both])
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(rows, schema.field("found").type)], schema=schema)

    return given.mapInArrow(run, out)
