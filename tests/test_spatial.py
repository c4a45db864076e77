"""Proximity operators against all-pairs brute force, with edge positions and a hot cell."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tractloom.operators import peers, spatial

R = 3958.7613


def miles(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    places = [(i, 40 + rng.random() * 2, -90 + rng.random() * 2) for i in range(60)]
    places += [(100, 71.9, -179.9), (101, 19.0, -155.0), (102, 40.5, -89.5), (103, 40.5, -89.5), (104, 89.9, 10.0), (105, -45.0, 170.0)]
    points = [(i, 2000 + i % 2, 40 + rng.random() * 2, -90 + rng.random() * 2) for i in range(300)]
    points += [(1000 + i, 2000, 40.5 + rng.random() * 0.01, -89.5 + rng.random() * 0.01) for i in range(400)]  # hot cell
    points += [(5000 + i, 2001, 40.6, -89.6) for i in range(50)]  # copies
    points += [(9000, 2000, 71.9, 179.95), (9001, 2002, 0.0, 0.0)]  # across the date line; a year with one point
    return (
        places, points,
        spark.createDataFrame(places, "tract_fips long, lat double, lon double"),
        spark.createDataFrame(points, "branch_id long, year int, lat double, lon double"),
    )


@pytest.mark.parametrize("radius", [0.5, 5.0, 25.0, 400.0])
def test_count_within(world, radius):
    places, points, p, b = world
    got = {(r["tract_fips"], r["year"]): r["n_within"] for r in spatial.count_within(p, b, radius, by=["year"]).collect()}
    want = {(i, y): sum(1 for _, py, la, lo in points if py == y and miles((lat, lon), (la, lo)) <= radius)
            for i, lat, lon in places for y in (2000, 2001, 2002)}
    assert got == want


@pytest.mark.parametrize("crowded", [2, 10_000])
def test_several_radii_on_one_way_down(world, crowded):
    """Deep trees and flat ones, a small and a large radius together."""
    places, points, p, b = world
    radii = {"a": 0.2, "b": 8.0, "c": 150.0}
    got = spatial.counts_within(p, b, radii, by=["year"], crowded=crowded)
    want = {(i, y): tuple(sum(1 for _, py, la, lo in points if py == y and miles((lat, lon), (la, lo)) <= r) for r in radii.values())
            for i, lat, lon in places for y in (2000, 2001, 2002)}
    assert {(r["tract_fips"], r["year"]): (r["a"], r["b"], r["c"]) for r in got.collect()} == want
    deep = spatial.nearest(p, b, by=["year"], crowded=crowded).collect()
    assert len(deep) == len(want)
    for r in deep:
        at = next((lat, lon) for i, lat, lon in places if i == r["tract_fips"])
        assert r["nearest_miles"] == pytest.approx(min(miles(at, (la, lo)) for _, py, la, lo in points if py == r["year"]), abs=1e-6)


def test_a_dense_spot_makes_a_deep_tree(spark):
    rows = spark.range(30_000).select((F.lit(40.0) + F.rand(1) * 1e-3).alias("lat"), (F.lit(-90.0) + F.rand(2) * 1e-3).alias("lon"), F.lit(1).alias("copies"))
    tree = spatial.CellTree(spatial._positioned(rows), [], 4.0, 64)
    assert tree.leaves.agg(F.max("copies")).first()[0] <= 64 and tree.depth >= 4
    assert tree.leaves.count() < 30_000 / 4
    assert [tree.level(n).agg(F.sum("copies")).first()[0] for n in (0, 1, tree.depth)] == [30_000] * 3


def test_count_without_groups(world):
    places, points, p, b = world
    got = {r["tract_fips"]: r["n_within"] for r in spatial.count_within(p, b, 30.0).collect()}
    assert got == {i: sum(1 for _, _, la, lo in points if miles((lat, lon), (la, lo)) <= 30.0) for i, lat, lon in places}


def test_nearest(world):
    places, points, p, b = world
    got = {(r["tract_fips"], r["year"]): r["nearest_miles"] for r in spatial.nearest(p, b, by=["year"]).collect()}
    assert len(got) == len(places) * 3
    for i, lat, lon in places:
        for y in (2000, 2001, 2002):
            assert got[(i, y)] == pytest.approx(min(miles((lat, lon), (la, lo)) for _, py, la, lo in points if py == y), abs=1e-6)


def test_recent_closures(spark):
    rows = [(1, 2000, 1.0, 1.0), (1, 2001, 1.5, 1.0), (2, 2000, 2.0, 2.0), (2, 2004, 2.0, 2.0), (3, 2004, 3.0, 3.0), (4, 2002, 4.0, 4.0), (4, 2003, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "branch_id long, year int, lat double, lon double")
    got = {(r["branch_id"], r["year"], r["lat"]) for r in spatial.recent_closures(df).collect()}
    assert got == {(1, 2002, 1.5), (1, 2003, 1.5), (1, 2004, 1.5), (2, 2001, 2.0), (2, 2002, 2.0), (2, 2003, 2.0), (4, 2004, 4.0)}


def test_knn_peers_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 4}", rng.gauss(0, 1), rng.gauss(5, 2), rng.expovariate(1), float(rng.randint(50, 100))) for i in range(600)]
    rows += [(1000 + i, "thin", 1.0, 1.0, 1.0, 90.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, st string, a double, b double, c double, score double")
    got = {}
    for r in peers.knn_peers(df, "id", "st", ["a", "b", "c"], "score").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["dist2"]))
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["id", "st", "a", "b", "c", "score"])
    for st, part in pdf.groupby("st"):
        z = (part[["a", "b", "c"]] - part[["a", "b", "c"]].mean()) / part[["a", "b", "c"]].std().replace(0, 1)
        pool = part["score"] >= 80
        if pool.sum() < 10:
            assert not set(part["id"]) & set(got)
            continue
        for i, row in z.iterrows():
            d = sorted(((z[pool & (part["id"] != part.loc[i, "id"])] - row) ** 2).sum(axis=1))[:3]
            assert [x for _, x in sorted(got[part.loc[i, "id"]])] == pytest.approx(d, abs=1e-9)


def test_peers_in_one_crowded_block(spark):
    """20,000 members in one block, a third of them at one point: exact peers, and few members opened per row."""
    import numpy as np

    from tractloom.session import stored

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(13_000, 3)), np.full((7_000, 3), 0.25)])
    df = spark.createDataFrame([(i, "only", 100.0, *map(float, v)) for i, v in enumerate(x)], "id long, st string, score double, a double, b double, c double")
    got = {}
    for r in peers.knn_peers(df, "id", "st", ["a", "b", "c"], "score").collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["peer"], r["dist2"])
    assert len(got) == 20_000
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    for i in [*range(0, 13_000, 97), *range(13_000, 13_010), 19_999]:
        d = ((z - z[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        best = np.lexsort((np.arange(len(d)), np.round(d, 12)))[:3]
        assert [got[i][n + 1][0] for n in range(3)] == best.tolist()
    points = stored(df.select("id", "st", F.array(*[F.col(c) for c in "abc"]).alias("z")).where("id < 13000"), "points")
    members, depth = peers.cut_by_count(points, "st", 3, 64)
    sizes = members.groupBy("cell").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 64 and sizes[1] <= 13_000 / 4
    assert depth >= peers.STEP  # deeper than one step
    opened = peers.opened_cells(points, members, "id", "st", 3, depth, 3)
    per_row = opened.select(F.aggregate("m", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert per_row[0] <= 0.1 * 13_000  # before the distances of the first opened cell tighten the bound


def test_peers_of_a_deep_tree(spark):
    """Cells of at most four members need several steps down the tree."""
    rng = random.Random(9)
    rows = [(i, f"s{i % 2}", float(rng.randrange(60, 100)), rng.gauss(0, 1), rng.choice([0.0, 1.0, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, st string, score double, a double, b double")
    shallow, deep = ({tuple(r) for r in peers.knn_peers(df, "id", "st", ["a", "b"], "score", leaf=n).collect()} for n in (10_000, 4))
    assert shallow == deep and len(deep) == 4500
