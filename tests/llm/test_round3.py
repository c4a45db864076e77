"""Sharding, prefix trie and source divergence against brute force, on odd rows and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tractloom.llm import prefix_trie as trie
from tractloom.llm.catalog import QUERIES, SQL
from tractloom.llm.divergence import source_divergence
from tractloom.llm.sharding import jump, shard_rows, write_shards

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_sharding", "op12_prefix_trie", "op13_source_divergence"])
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, DATA), SQL[name], duck(DATA)) == []


def slow_jump(key, shards):
    last, ahead = -1, 0
    while ahead < shards:
        last = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


def test_jump_moves_only_into_the_new_shard():
    r = random.Random(3)
    keys = np.array([0, 1, 2**62, *(r.getrandbits(60) for _ in range(4000))], np.int64)
    for shards in (1, 2, 24, 1000):
        now, grown = jump(keys, shards), jump(keys, shards + 1)
        assert now.tolist() == [slow_jump(int(k), shards) for k in keys]
        moved = now != grown
        assert (grown[moved] == shards).all()
        assert moved.mean() < 3 / (shards + 1)
    assert np.bincount(jump(keys, 24)).min() > 100


def check_shards(rows, source, shards):
    assert Counter((r["row"].doc_id, r["row"].text) for r in rows) == Counter((r.doc_id, r.text) for r in source)
    slots, order = defaultdict(list), defaultdict(list)
    for r in rows:
        key, text = "" if r["row"].doc_id is None else str(r["row"].doc_id), (r["row"].text or "").encode()
        number = int(hashlib.md5(key.encode()).hexdigest()[:15], 16)
        assert (r["size"], r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        assert (r.shard, r.grown_shard) == (slow_jump(number, shards), slow_jump(number, shards + 1))
        slots[r.shard].append(r.slot)
        order[r.shard].append((r.slot, hashlib.md5(f"{key}:{r.text_crc32}:{r['size']}".encode()).hexdigest()[:15]))
    for shard, got in slots.items():
        assert sorted(got) == list(range(len(got)))
        assert [h for _, h in sorted(order[shard])] == sorted(h for _, h in order[shard])


def test_shard_rows(spark, odd, none, tmp_path):
    sharded = shard_rows(odd, 5)
    rows = sharded.collect()
    check_shards(rows, odd.collect(), 5)
    assert set(rows[0]["row"].asDict()) == set(odd.columns)
    assert shard_rows(none, 5).count() == 0
    write_shards(sharded, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    with pytest.raises(ValueError):
        shard_rows(odd, 0)


def test_shards_of_one_hot_key(spark):
    """A third of all rows have one key and text, another third one key and different texts."""
    rows = [(7, "same")] * 700 + [(8, f"text {i}") for i in range(700)] + [(i, "x") for i in range(100, 800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check_shards(shard_rows(docs, 4, carry=["doc_id", "text"]).collect(), docs.collect(), 4)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_trie(turns, head, base):
    own = defaultdict(list)
    for c, at, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((at is not None, at or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, said in own.items():
        h = head(c)
        whole = own.get(base(c), [])[:h] + said[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, of in members.items():
        value = (len(of) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += p not in children
    return Counter(
        (min(of), len(p), min(members[p[:-1]]) if p else None, len(of), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, of in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string, depth string, f1 string, conv string, rid string"
HEAD, BASE = (lambda c: c % 4), (lambda c: c - c % 20)


def found(spark, rows, **more):
    turns = spark.createDataFrame([(*r, "d", "f", "c", "r") for r in rows], TURNS).repartition(5)
    got = trie.prefix_trie(turns, F.pmod(F.col("conv"), F.lit(4)), F.col("conv") - F.col("conv") % 20, **more).collect()
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got), got


def conversations(seed, convs=60, kinds=3, most=6):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "bot"]), " ".join(["w"] * r.randrange(kinds))) for c in range(convs) if c != 20 for t in range(r.randrange(1, most))]


def test_trie(spark):
    rows = conversations(1)
    got, whole = found(spark, rows)
    assert got == slow_trie(rows, HEAD, BASE)
    # the last turn of a node is where it says
    said = defaultdict(list)
    for c, t, role, text in sorted(rows):
        said[c].append((role, text))
    for r in whole:
        if r.depth:
            assert len(said[r.turn_conv]) >= r.turn_position >= 1


def test_trie_odd(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 5, "a", "x y"), (1, 5, "a", "x y"), (1, 5, "a", "z"), (None, 1, "a", "b"), (-3, 1, "a", "b"), (23, 1, "a", "b"),
            (40, 0, "u", "q " * 20_000), (41, 0, "u", "other"), (41, 1, "u", "more"), (44, 0, "u", "q " * 20_000), (2**40, 3, "a", None)]
    assert found(spark, rows)[0] == slow_trie(rows, lambda c: c % 4, lambda c: c - (abs(c) % 20) * (1 if c > 0 else -1))
    assert found(spark, [])[0] == Counter()


def test_trie_of_long_conversations(spark):
    """Cells cut by turn number, by content and by place in the input: equal numbers, equal turns, deep shared prefixes."""
    r = random.Random(4)
    shared = [("u", f"t{i}") for i in range(90)]
    rows = [(c, 30 * i, *t) for c in (0, 4, 8) for i, t in enumerate(shared + [("u", f"only {c}")] * c)]
    rows += [(16, 7, "u", f"v{r.randrange(40)}") for _ in range(80)] + [(12, 1, "u", "same")] * 70 + conversations(5, 40)
    assert found(spark, rows, limit=10)[0] == slow_trie(rows, HEAD, BASE)


def test_trie_finds_wrong_fingerprints(spark, monkeypatch):
    """With base 1 the sums do not know the order of turns; verification must notice and take other bases."""
    good, tried = trie._bases, []
    monkeypatch.setattr(trie, "_bases", lambda attempt: tried.append(attempt) or ([1] * 4 if attempt == 0 else good(attempt)))
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (4, 0, "u", "b"), (4, 1, "u", "a")]
    assert found(spark, rows)[0] == slow_trie(rows, HEAD, BASE)
    assert tried == [0, 1]


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_divergence(docs, least, report):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = LETTERS.findall((text or "").translate(LOW))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = Counter()
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for other, s in groups if other == lang]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        pairs = [(-sum(abs(p[source][t] - p[s][t]) for t in kept), s.encode()) for s in sources if s != source]
        terms = [(q[t] - p[source][t], t.encode()) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, rows in (("pair", pairs), ("term", sorted(terms)[:report])):
            out.update((lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(rows), 1))
    return out


def audited(docs, **more):
    got = source_divergence(docs, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return Counter(tuple(r) for r in got.collect())


def texts(seed, rows=400, sources=5):
    r = random.Random(seed)
    words = ["Über", "über", "ÀB", "a", "B", "b1c", "don't", "日本", "x_y", "z", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6))]
    return [(r.choice(["en", "de", None]), r.choice([None, *(f"s{i}" for i in range(sources))]), r.choice([None, ""]) if r.random() < 0.1 else " ".join(r.choices(words, k=r.randrange(1, 30)))) for _ in range(rows)]


@pytest.mark.parametrize("bits", [63, 3])
def test_divergence(spark, bits):
    """With 3 bits nearly all terms share a digest with others and must be told apart by their strings."""
    rows = texts(2) + [("fr", "s1", "rare words"), ("fr", "s2", None), ("it", "alone", "a b")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(docs, least_docs=20, report=7, bits=bits) == slow_divergence(rows, 20, 7)


def test_divergence_odd(odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert audited(odd, least_docs=2, gathered=1000) == slow_divergence(rows, 2, 50)
    assert audited(none) == Counter()


def test_divergence_in_blocks(spark):
    """More sources and terms than one tile holds, and one source with half of all rows."""
    rows = texts(8, 300, 9) + [("en", "big", "a b")] * 300
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(docs, least_docs=2, term_block=4, source_block=3) == slow_divergence(rows, 2, 50)
