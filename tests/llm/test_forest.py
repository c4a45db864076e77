"""The forest of the near-duplicate join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.llm import components as C
from tractloom.llm import ngram_join
from tractloom.llm.ngram_join import DEPTH, TREES, chance, matches, near_duplicates, next_depth


@pytest.mark.parametrize("rows_in_batch", ["10000", "7"])
def test_matches_are_longest_shared_prefixes(spark, rows_in_batch):
    """At every length, the pairs connect exactly the rows that share a prefix of that length in some tree."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_batch)
    r = np.random.default_rng(1)
    sig = r.integers(0, 3, (300, TREES * DEPTH)).astype(np.uint16)
    sig[50:90] = sig[50]
    sig[50:90, ::7] = r.integers(0, 2, (40, len(range(0, TREES * DEPTH, 7))))
    rows = [(i, x.byteswap().tobytes()) for i, x in enumerate(sig)]
    sets = spark.createDataFrame(rows, "rep long, sig binary").repartition(5)
    pairs = [(x.a, x.b, x.depth) for x in matches(sets, 4).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    trees = sig.reshape(len(sig), TREES, DEPTH)
    for depth in range(4, DEPTH + 1):
        assert sorted(_classes(len(sig), [(a, b) for a, b, d in pairs if d >= depth])) == sorted(
            _classes(len(sig), [(i, j) for i in range(len(sig)) for j in range(i) if (trees[i, :, :depth] == trees[j, :, :depth]).all(1).any()])
        )


def _classes(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_prefixes_are_shortened_until_the_target():
    assert next_depth({20: 10_000}, DEPTH, 0.8, 0.999) == DEPTH  # all links equal: whole signatures find them
    assert next_depth({0: 10_000}, DEPTH, 0.8, 0.999) == 6  # all at the threshold
    assert next_depth({}, DEPTH, 0.8, 0.999) == 6  # nothing found proves nothing
    depths = [next_depth({0: share, 15: 1000 - share}, DEPTH, 0.8, 0.9999) for share in (0, 30, 200, 1000)]
    assert depths == sorted(depths, reverse=True) and depths[-1] == 5
    assert chance(0.8, 5) >= 0.9999


@pytest.mark.parametrize("spread", [2, 20])
def test_links_equal_all_pairs(spark, monkeypatch, spread):
    """Versions of 40 texts with few or many words changed, compared in several rounds of shortening; none is lost."""
    r = random.Random(spread)
    texts = []
    for k in range(40):
        body = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        for _ in range(6):
            new = list(body)
            for _ in range(r.randrange(spread + 1)):
                new[r.randrange(len(new))] = f"v{r.randrange(5000)}"
            texts.append(" ".join(new[: len(new) - r.randrange(4)]))
    rounds = []
    real = ngram_join.next_depth
    monkeypatch.setattr(ngram_join, "next_depth", lambda *x: rounds.append(real(*x)) or rounds[-1])
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = near_duplicates(docs).select("row.doc_id", "row.text", "class_id", "n_links", "class_size", "kept").collect()
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.text.split() for x in got)]
    links = [(i, j) for i in range(len(got)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    assert links and rounds[-1] < DEPTH
    assert [x.n_links for x in got] == [sum(i in link for link in links) for i in range(len(got))]
    label = _classes(len(got), links)
    for at in set(label):
        mine = [x for x, own in zip(got, label, strict=True) if own == at]
        assert {(x.class_id, x.class_size) for x in mine} == {(min(x.doc_id for x in mine), len(mine))}
        assert [x.doc_id for x in mine if x.kept] == [min(x.doc_id for x in mine)]


def test_rounds_move_about_one_edge_a_node(spark, monkeypatch):
    """Members of a large group meet the same few least rows in many trees."""
    r = random.Random(4)
    edges = [(i, r.randrange(20)) for i in range(20, 420) for _ in range(24)] + [(500, 501), (502, 501), (7, 7)]
    written = {}

    def noted(df, name, *more):
        written[name] = df.count()
        return real(df, name, *more)

    real = C.stored
    monkeypatch.setattr(C, "stored", noted)
    got = {x.node: x.label for x in C.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    nodes = sorted({x for e in edges for x in e})
    label = dict(zip(range(503), _classes(503, edges), strict=True))
    assert got == {x: label[x] for x in nodes}
    assert written["t-edges"] <= 2 * 1.3 * len(nodes)


def test_a_block_links_each_set_to_the_least():
    linked = np.ones((5, 4), bool)
    a, b = ngram_join._spanning(np.array([9, 3, 5, 7, 11]), np.array([8, 4, 6, 10]), linked)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(x, 3) for x in range(4, 12)]


def test_the_kept_row_does_not_depend_on_partitions(spark):
    """Rows of one class that share the least id."""
    body = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(5, f"{body} a{i}") for i in range(12)] + [(None, body), (9, body)], "doc_id long, text string")
    kept = {tuple(x[0] for x in near_duplicates(d).filter("kept").select(F.col("row.text")).collect()) for d in (docs.repartition(1), docs.repartition(7), docs.orderBy(F.rand(3)))}
    assert len(kept) == 1 and len(next(iter(kept))) == 1
