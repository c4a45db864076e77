"""Attributions of trees add up and match the definition by enumeration."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tractloom.operators import learning as L


def average_precision(y, p):
    """Ties share their precision."""
    total = sum(y)
    return sum((y[p == s].sum()) * y[p >= s].sum() / (p >= s).sum() for s in np.unique(p)) / total


def log_loss(y, p):
    return -np.mean(np.where(y > 0, np.log(p), np.log1p(-p)))


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0.2).astype(int)
    rows = [(i, float(a), float(b), None if i % 11 == 0 else float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    model = L.fit_trees(df.where("id < 450"), df.where("id >= 450"), ["a", "b", "c"], "y", L.Settings(rounds=5, depth=3, rate=0.4, feature_share="all"))
    return df, model


def test_tree_attributions(spark, fitted):
    df, model = fitted
    features = ["a", "b", "c"]
    some = df.where("id < 40")
    got = {}
    for r in L.tree_attributions(model, some, features, ["id"]).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["attribution"]
    leaves = L.tree_paths(model, spark)
    scored = model.transform(L.with_inputs(some, features)).select("id", vector_to_array("__x").alias("x"), vector_to_array("probability")[1].alias("p")).collect()

    def expected(x, known):
        total = 0.0
        for value, path in leaves:
            w = 1.0
            for i, low, high, share in path:
                w *= (float(low < x[i] <= high) if i in known else share)
            total += 2 * value * w
        return total

    for r in scored:
        x, inputs = r["x"], range(6)
        full, base = expected(x, set(inputs)), expected(x, set())
        assert full == pytest.approx(math.log(r["p"] / (1 - r["p"])), abs=1e-6)
        assert sum(got[r["id"]].values()) == pytest.approx(full - base, abs=1e-9)
    x = scored[0]["x"]
    phi = [0.0] * 6
    for i in range(6):
        rest = [j for j in range(6) if j != i]
        for k in range(6):
            for s in itertools.combinations(rest, k):
                w = math.factorial(k) * math.factorial(5 - k) / math.factorial(6)
                phi[i] += w * (expected(x, {*s, i}) - expected(x, set(s)))
    for n, f in enumerate(features):
        assert got[scored[0]["id"]][f] == pytest.approx(phi[n] + phi[n + 3], abs=1e-9)


def test_spatial_splits_cover_every_row_once(spark):
    df = spark.createDataFrame([(i, i % 4 or None) for i in range(200)], "id long, st int")
    for roles in L.spatial_splits(df, "st", ["id"], folds=5).values():
        tested = [r[0] for of in roles.values() for r in df.where(of["test"]).select("id").collect()]
        assert sorted(tested) == list(range(200))
        for of in roles.values():
            assert sum(df.where(hit).count() for hit in of.values()) == 200


def test_best_prefix():
    assert L.best_prefix([0.1, 0.3, 0.2, 0.2, 0.9], 2) == (2, True)
    assert L.best_prefix([0.1, 0.3, 0.2, 0.4, 0.4], 2) == (4, False)
    assert L.best_prefix([None, None], 1) == (2, False)


def noisy(spark, n=1500):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + rng.normal(scale=1.5, size=n) > 1.2).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y int")


def test_trees_stop_after_the_best_average_precision(spark):
    """The kept rounds are those of the best average precision; log loss is best elsewhere."""
    df = noisy(spark)
    train, val = df.where("id < 1000"), df.where("id >= 1000")
    settings = L.Settings(rounds=60, depth=4, rate=0.3, feature_share="all", patience=6, first_rounds=8)
    kept = len(L.fit_trees(train, val, ["a", "b"], "y", settings).stages[-1].treeWeights)
    whole = L.fit_trees(train, val, ["a", "b"], "y", L.Settings(rounds=60, depth=4, rate=0.3, feature_share="all", patience=1000))
    # the run with boundless patience has the best of all 60 rounds; grow them again to see every one
    full = L.GBTClassifier(labelCol="__y", featuresCol="__x", maxIter=60, maxDepth=4, stepSize=0.3, subsamplingRate=0.85, featureSubsetStrategy="all", minInstancesPerNode=5, seed=42)
    inputs = [L.PipelineModel(whole.stages[:-1]).transform(L.with_inputs(x, ["a", "b"])).selectExpr("id", "__x", "cast(y as double) as __y") for x in (train, val)]
    model = full.fit(inputs[0])
    rows = L.prefix_probabilities(model, inputs[1], ["id", "__y"]).toPandas()
    after = {n: g.sort_values("id") for n, g in rows.groupby("prefix")}
    last = model.transform(inputs[1]).select("id", vector_to_array("probability")[1].alias("p")).toPandas().sort_values("id")
    assert np.allclose(after[60]["y_prob"], last["p"])
    precision = [average_precision(after[n]["__y"].to_numpy(), after[n]["y_prob"].to_numpy()) for n in range(1, 61)]
    losses = [log_loss(after[n]["__y"].to_numpy(), after[n]["y_prob"].to_numpy()) for n in range(1, 61)]
    best = 0
    for i, q in enumerate(precision):
        if q > precision[best] + 1e-12:
            best = i
        elif i - best >= 6:
            break
    assert kept == best + 1
    assert len(whole.stages[-1].treeWeights) == int(np.argmax(np.round(precision, 12))) + 1
    assert best != int(np.argmin(losses))


def test_stored_models_score_alike(spark, tmp_path):
    df = noisy(spark, 900).withColumn("year", F.pmod("id", F.lit(3)).cast("int")).withColumn("z", 1 - F.col("y"))
    models, labels, quick = {"both": ["a", "b"], "one": ["a"]}, {1: "y", 2: "z"}, L.Settings(rounds=4, depth=2, first_rounds=4, patience=3)
    fitted = L.final_models(df, models, labels, 3, quick)
    L.save_models(fitted, str(tmp_path / "m"))
    loaded = L.load_models(str(tmp_path / "m"), list(fitted))
    one, two = ({tuple(r) for r in L.score_models(df, m, models, ["id"]).collect()} for m in (fitted, loaded))
    assert one == two and len(one) == 900 * 4
    model, iso = fitted["one", 2]
    alone = {(r["id"], r["y_prob"], r["y_prob_calibrated"]) for r in L.calibrated(iso, L.predict(model, df, ["a"])).collect()}
    assert alone == {(i, p, c) for i, name, h, p, c in one if (name, h) == ("one", 2)}


def test_slow_rate_keeps_its_rounds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 2))
    y = (x[:, 0] + x[:, 1] + rng.normal(scale=0.5, size=1500) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y int")
    model = L.fit_trees(df.where("id < 1000"), df.where("id >= 1000"), ["a", "b"], "y", L.Settings(rounds=12, depth=2, feature_share="all"))
    assert len(model.stages[-1].trees) >= 10


def test_permutation_finds_the_feature_that_matters(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 2))
    rows = [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = L.fit_trees(df.where("id < 600"), df.where("id >= 600"), ["a", "b"], "y", L.Settings(rounds=4, depth=2, feature_share="all"))
    got = L.permutation_importance(model, df, ["a", "b"], "y", ["id"], rows_in_bucket=100).collect()
    drop = {r["feature"]: r["ap_drop"] for r in got}
    assert drop["a"] > 0.2 and abs(drop["b"]) < 0.05
