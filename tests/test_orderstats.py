"""Ranks, quantiles and metrics against brute force, including heavy ties and one hot group."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tractloom.operators import evaluation as E
from tractloom.operators import orderstats
from tractloom.operators.orderstats import percentile_rank, quantiles, ranked_values


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else f"g{i % 7}"
        value = rng.choice([None, 0.0, -5.5, 1e-9, 12.0, 1e12, rng.gauss(0, 3), rng.gauss(1000, 0.001)])
        out.append((i, group, value))
    return pd.DataFrame(out, columns=["id", "g", "v"])


def test_percentile_rank_like_pandas(spark, rows):
    got = percentile_rank(spark.createDataFrame(rows, "id long, g string, v double").replace(float("nan"), None), ["g"], "v", "p").toPandas()
    got = got.set_index("id").sort_index()["p"]
    want = rows.groupby("g")["v"].rank(pct=True) * 100
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), rtol=1e-12, equal_nan=True)


def test_quantiles_interpolate(spark, rows):
    ps = [0.0, 0.013, 0.1, 0.25, 0.5, 0.777, 0.99, 1.0]
    df = spark.createDataFrame(rows, "id long, g string, v double").replace(float("nan"), None)
    got = {(r["g"], r["p"]): r["quantile"] for r in quantiles(df, ["g"], "v", ps).collect()}
    for g, part in rows.groupby("g"):
        for p in ps:
            assert got[(g, p)] == pytest.approx(part["v"].quantile(p), rel=1e-12, abs=1e-12)


def test_ranked_values_without_groups(spark):
    df = spark.createDataFrame([(x,) for x in [3.0, 1.0, 1.0, 2.0, None]], "v double")
    got = sorted((r["v"], r["n"], r["n_before"], r["n_total"]) for r in ranked_values(df, [], "v").collect())
    assert got == [(1.0, 2, 0, 4), (2.0, 1, 2, 4), (3.0, 1, 3, 4)]


def test_null_group_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["p"] for r in percentile_rank(df, ["g"], "v", "p").collect()}
    assert got == {(None, 1.0): 50.0, (None, 2.0): 100.0, ("a", 5.0): 100.0}


def test_auc_and_ap_by_pairs(spark):
    rng = random.Random(5)
    data = [(f, round(rng.random(), rng.choice([1, 6])), int(rng.random() < 0.2)) for f in ("A", "B") for _ in range(400)]
    data += [("one", 0.3, 1), ("one", 0.7, 1)]
    got = {r["fold"]: r for r in E.scores(spark.createDataFrame(data, "fold string, y_prob double, y_true int"), ["fold"]).collect()}
    for fold in ("A", "B"):
        pos = [s for f, s, y in data if f == fold and y]
        neg = [s for f, s, y in data if f == fold and not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[fold]["auc"] == pytest.approx(auc, abs=1e-12)
        cuts = sorted(set(pos + neg), reverse=True)
        recall, ap = 0.0, 0.0
        for c in cuts:
            tp, n = sum(p >= c for p in pos), sum(s >= c for s in pos + neg)
            ap += (tp / len(pos) - recall) * tp / n
            recall = tp / len(pos)
        assert got[fold]["ap"] == pytest.approx(ap, abs=1e-12)
        assert got[fold]["lift"] == pytest.approx(ap * (len(pos) + len(neg)) / len(pos), abs=1e-9)
    assert got["one"]["auc"] is None and got["one"]["ap"] is None and got["one"]["brier"] == pytest.approx(0.29)


def test_precision_leaves_out_sizes_beyond_the_data(spark):
    df = spark.createDataFrame([(i, i / 200.0, int(i >= 150)) for i in range(200)], "id int, y_prob double, y_true int")
    got = {r["top_n"]: r["precision"] for r in E.precision_at(df, ["id"]).collect()}
    assert got == {100: 0.5}


def test_decision_curve_by_hand(spark):
    df = spark.createDataFrame([("f", 0.2, 1), ("f", 0.2, 0), ("f", 0.05, 0), ("f", 0.6, 1)], "fold string, y_prob double, y_true int")
    r = E.decision_curve(df, ["fold"]).where("threshold = 0.2").first()
    assert (r["n_treated"], r["n_caught"]) == (3, 2)
    assert r["nb_model"] == pytest.approx(2 / 4 - 1 / 4 * 0.25)


def test_unsupported_horizon():
    with pytest.raises(ValueError):
        E.build_folds(2)
    assert E.build_folds(3)[-1] == ("F8", 2009, 2019, 2020, 2021, 2021)


def test_narrow_band_is_cut_by_count(spark):
    """A million distinct values within one millionth of each other, next to a few far away: no range above one per cent."""
    rows = spark.range(0, 1_000_000, 1, 8).select(F.lit("g").alias("g"), (F.lit(1000.0) + F.col("id") * 1e-9).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("g", -1e300), ("g", 0.0), ("g", 1e300), ("h", 5.0), ("h", float("nan")), (None, 1.0)], "g string, v double"))
    ranges = orderstats.value_ranges(rows, ["g"], "v", limit=10_000)
    sizes = ranges.groupBy("g", "__c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sizes.agg(F.max("n")).first()[0] <= 10_000
    order = [(r["lo"], r["hi"]) for r in sizes.where("g = 'g'").orderBy("__c").collect()]
    assert all(a[1] < b[0] for a, b in zip(order, order[1:]))
    ranked = orderstats.ranked_values(rows, ["g"], "v", limit=10_000)
    wrong = ranked.where("g = 'g' and abs(v) < 1e9 and v > 0").where("n_before <> 2 + cast(round((v - 1000.0) * 1e9) as long) or n_total <> 1000003")
    assert wrong.isEmpty()
    assert {(r["g"], r["n_before"], r["n_total"]) for r in ranked.where("g is null or g = 'h'").collect()} == {("h", 0, 2), ("h", 1, 2), (None, 0, 1)}


def test_crowded_slivers_are_cut_again(spark):
    """Values that crowd towards one point need several rounds."""
    rows = spark.createDataFrame([(float(2.0 ** -(i / 40)),) for i in range(1200)] + [(float(3 + 2.0**-i),) for i in range(40)], "v double")
    ranked = orderstats.ranked_values(rows, [], "v", limit=7).orderBy("v").collect()
    assert [r["n_before"] for r in ranked] == list(range(len(ranked)))
    assert orderstats.value_ranges(rows.distinct(), [], "v", limit=7).groupBy("__c").count().agg(F.max("count")).first()[0] <= 7
