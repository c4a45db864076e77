"""Inputs that once blew up or crashed: brackets, long lines, long words, empty vectors, NUL texts, words seen once."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tractloom.llm import packing, semicrf
from tractloom.llm.chat import format_chats
from tractloom.llm.query_pii import op10_semicrf_pii
from tractloom.llm.secrets import NEAR, findings
from tractloom.llm.topk import top_k

DATA = "/root/testdata/sf0.001"


def test_segments_stay_bounded():
    spans = semicrf.Spans()
    for text in ("1" + "(" * 20_000, "1 " * 20_000, "1" + " (" * 10_000, "a@" * 5000, "12 [at] " * 4000):
        started = time.time()
        n = 0
        for tokens in semicrf.stretches(text):
            for block in semicrf.segment_blocks(text, tokens, spans):
                n += len(block)
                assert len(block) <= 512 * semicrf.MAX_ALL
        assert n <= 40 * len(text)
        assert time.time() - started < 30
    weights = np.full(semicrf.FEATURES, -1.0)
    assert semicrf.find("12345 " * 50_000, weights, spans) == ([], [])


def test_decode_finds_the_best_reading():
    """Against all readings, by recursion."""
    r = random.Random(1)
    spans = semicrf.Spans()
    for _ in range(60):
        text = "".join(r.choice(["1", "23", " ", ".", "@", "a", "("]) for _ in range(9)) + "7"
        weights = np.random.default_rng(r.randrange(99)).normal(size=semicrf.FEATURES)
        for tokens in semicrf.stretches(text):
            segments = semicrf.candidates(text, tokens, spans)
            value = weights[spans.table[segments[:, 4]]].sum(2).max(1) if len(segments) else []

            def best(at, tokens=tokens, segments=segments, value=value):
                if at == len(tokens):
                    return 0.0
                return max([best(at + 1), *(value[n] + best(s[1]) for n, s in enumerate(segments) if s[0] == at)])

            got = semicrf.decode(len(tokens), semicrf.segment_blocks(text, tokens, spans, block=2), spans, weights)
            assert sum(x[3] for x in got) == pytest.approx(best(0))
            assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))


def plain_base(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        out += [("card", m)] * (16 <= len(digits) <= 19 and total % 10 == 0)
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(kind, m.start(), m.end()) for kind, m in out]


def test_personal_data_of_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op10_semicrf_pii(spark, DATA).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        base, r = plain_base(text), got[doc]
        counts = [sum(k == kind for k, _, _ in base) for kind in semicrf.KINDS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        joined = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(spans) and len(spans) == len(base) + r.n_added


def test_findings_are_bounded_and_in_place(spark):
    run = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
    r = random.Random(2)
    long = "".join(r.choice(["a1B2c3D4e5F6g7H8", "x" * 70, ";", ".", "'", "é"]) for _ in range(3000))
    texts = [long, f"pre {long} post {'y' * 200}", "k='0123456789abcdef'; z", "\x00" + "a" * 20 + "\x00b" + "c" * 16, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = findings(docs, carry=["id"]).collect()
    want = [(i, w, n, m[0], word[: m.start()], word[m.end() :]) for i, t in enumerate(texts) for w, word in enumerate(re.split(r"[\x20\x09-\x0D]+", t or ""))
            for n, m in enumerate(run.finditer(word.replace("\x00", "�")))]
    assert sorted((r["row"].id, r.word_at, r.run_at, r.candidate) for r in got) == sorted(x[:4] for x in want)
    sides = {x[:3]: x[4:] for x in want}
    for f in got:
        left, right = (s.replace("\x00", "�") for s in sides[f["row"].id, f.word_at, f.run_at])
        assert left.endswith(f.left) and right.startswith(f.right)
        assert max(map(len, (f.left, f.right, f.before, f.before2, f.after))) <= NEAR
        assert len(f.left) >= min(len(left), 16) and len(f.right) >= min(len(right), 16)


def test_empty_vectors(spark):
    rows = [(0, []), (50, []), (100, [1.0, 2.0]), (3, [0.5, 0.5]), (7, []), (150, None), (200, [float("nan")])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0, k=2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 7, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 7, 0), (100, 1, 3, 128 * 256 + 128 * 512)]


def test_null_text_is_not_nul(spark):
    chats = spark.createDataFrame([(1, 0, "u", None), (2, 0, "u", "\x00"), (2, 1, "u", "b"), (3, 0, "u", "")], "conv_id long, turn long, role string, text string")
    assert sorted(r.conv_id for r in format_chats(chats).collect()) == [1, 2, 3]


def test_words_are_kept_from_their_second_sight():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tokens = packing.WordTokens(path)
    tokens.encode(pa.array(["alpha beta alpha"]))
    assert not tokens.known
    first = tokens.encode(pa.array(["alpha gamma."]))[0].tolist()
    assert "alpha" in tokens.known and "gamma" not in tokens.known
    assert tokens.encode(pa.array(["alpha gamma."]))[0].tolist() == first
    assert packing.word_tokens(path) is packing.word_tokens(path)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * n if n else None for n in (10, 0, 5 << 20, 3, 1 << 20, 1 << 20, 7)])})
    parts = list(packing._slices(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) == 4
