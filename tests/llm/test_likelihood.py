"""The semi-Markov model against sums over all readings."""

import math

import numpy as np
import pytest

from tractloom.llm import semicrf


def readings(n, segments, at=0):
    """Every way to read tokens at..n-1, as lists of (segment number, kind)."""
    if at == n:
        yield []
        return
    yield from readings(n, segments, at + 1)
    for number, (start, end, *_) in enumerate(segments):
        if start == at:
            for rest in readings(n, segments, end):
                for kind in range(len(semicrf.KINDS)):
                    yield [(number, kind), *rest]


def cases_of(texts, spans):
    out = []
    for text in texts:
        for tokens in semicrf.stretches(text):
            segments = semicrf.candidates(text, tokens, spans)
            known = {(s, e): row for _, _, s, e, row in segments.tolist()}
            truth = {(k, s, e): (known[s, e], k) for k, s, e in semicrf.base_spans(text)}
            out.append((len(tokens), segments, truth))
    return out


def test_chances_equal_sums_over_readings():
    spans = semicrf.Spans()
    cases = cases_of(["a@b.c 7", "1.2.3.4", "12", "x 1-2"], spans)
    batch = semicrf.Batch(cases)
    weights = np.random.default_rng(3).normal(size=semicrf.FEATURES) / 4
    total, chance = batch.chances(weights[spans.table[batch.rows]].sum(2)[batch.place])
    for c, (n, segments, _) in enumerate(cases):
        scores = weights[spans.table[segments[:, 4]]].sum(2)
        found = [(math.exp(sum(scores[x] for x in reading)), reading) for reading in readings(n, segments.tolist())]
        z = sum(w for w, _ in found)
        assert total[c] == pytest.approx(math.log(z))
        for number, (start, end, *_) in enumerate(segments.tolist()):
            mine = np.flatnonzero((batch.of == c) & (batch.start == start) & (batch.end == end))
            for kind in range(len(semicrf.KINDS)):
                want = sum(w for w, reading in found if (number, kind) in reading) / z
                assert chance[mine[0], kind] == pytest.approx(want)


def test_gradient_is_the_slope_of_the_likelihood():
    spans = semicrf.Spans()
    batch = semicrf.Batch(cases_of(["to a@b.c 7", "at 1.2.3.4, 5"], spans))
    weights = np.random.default_rng(5).normal(size=semicrf.FEATURES) / 4
    slope, _ = batch.gradient(weights, spans.table)
    for slot in np.flatnonzero(np.abs(slope) > 1e-3)[::37]:
        up, down = weights.copy(), weights.copy()
        up[slot] += 1e-5
        down[slot] -= 1e-5
        assert slope[slot] == pytest.approx((batch.gradient(up, spans.table)[1] - batch.gradient(down, spans.table)[1]) / 2e-5, rel=1e-3, abs=1e-4)


def test_fit_raises_the_likelihood():
    texts = [f"write to u{i}@m{i % 3}.example.com or call +1 (555) 010-{1000 + i}, room {i} of {1900 + i}" for i in range(40)]
    spans = semicrf.Spans()
    cases = cases_of(texts, spans)
    after = [sum(b.gradient(w, spans.table)[1] for b in semicrf.batches(cases)) for w in (np.full(semicrf.FEATURES, -0.1), semicrf.fit(texts, passes=1), semicrf.fit(texts))]
    assert after[0] < after[1] < after[2] < 0
    assert semicrf.find("room 12 of 1999", semicrf.fit(["room 7 of 1950", "1 2 3"]), semicrf.Spans()) == ([], [])
