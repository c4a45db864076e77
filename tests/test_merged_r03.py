"""Fits on many rows merge those that the trees cannot tell apart; every row counts as before."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tractloom.operators import learning as L


@pytest.fixture
def merging(monkeypatch):
    """Fits on more than 100 rows merge them; the rows, blocks and weights that reach MLlib are noted."""
    monkeypatch.setattr(L, "ROWS_APART", 100)
    monkeypatch.setattr(L, "BLOCKS", 50)
    seen, real = [], L.GBTClassifier.fit

    def fit(self, data):
        seen.append(data.agg(F.count("*"), F.sum("__w")).first() if "__w" in data.columns else (data.count(), None))
        return real(self, data)

    monkeypatch.setattr(L.GBTClassifier, "fit", fit)
    return seen


def coarse(spark, n=4000):
    """Few distinct values, so that bins are the values; copies, and missing values."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, n), rng.integers(-4, 5, n) / 2
    y = (a / 9 + b / 4 + rng.normal(scale=0.4, size=n) > 0.6).astype(int)
    rows = [(i, None if i % 17 == 0 else int(u), float(v), int(t)) for i, (u, v, t) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "id long, a long, b double, y int")


def test_merged_rows_grow_the_same_trees(spark, merging, monkeypatch):
    df = coarse(spark)
    train, val = df.where("id < 3000"), df.where("id >= 3000")
    settings = L.Settings(rounds=6, depth=4, rate=0.3, subsample=1.0, feature_share="all", min_rows=20, patience=10, first_rounds=6)
    merged = L.fit_trees(train, val, ["a", "b"], "y", settings)
    kinds = train.select("a", "b", "y").distinct().count()
    blocks, weight = merging[-1]
    assert blocks <= kinds + 50 < 500 and weight == pytest.approx(3000)
    monkeypatch.setattr(L, "ROWS_APART", 100_000)
    apart = L.fit_trees(train, val, ["a", "b"], "y", settings)
    assert tuple(merging[-1]) == (3000, None)
    assert len(merged.stages[-1].trees) == len(apart.stages[-1].trees)
    one, two = ({r["id"]: r["y_prob"] for r in L.predict(m, df, ["a", "b"]).collect()} for m in (merged, apart))
    assert one == pytest.approx(two, abs=1e-9)
    one, two = ({(r["id"], r["feature"]): r["attribution"] for r in L.tree_attributions(m, val, ["a", "b"], ["id"]).collect()} for m in (merged, apart))
    assert one == pytest.approx(two, abs=1e-9)


def test_merged_fits_of_continuous_inputs(spark, merging, tmp_path):
    """Bins of equal shares, bagging by block; dependence and stored models go by the raw inputs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 2))
    y = (x[:, 0] + x[:, 1] + rng.normal(scale=0.3, size=2000) > 0).astype(int)
    rows = [(i, float(a), None if i % 13 == 0 else float(b), 1.0, int(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df, features = spark.createDataFrame(rows, "id long, a double, b double, same double, y int"), ["a", "b", "same"]
    quick = L.Settings(rounds=4, depth=3, rate=0.4, first_rounds=4, patience=3)
    model = L.fit_trees(df.where("id < 1500"), df.where("id >= 1500"), features, "y", quick)
    assert merging[-1][1] == pytest.approx(1500)
    scored = L.predict(model, df, features).where("id >= 1500")
    assert scored.where((F.col("y_prob") >= 0.5) == (F.col("y") == 1)).count() > 425
    got = {r["feature"]: r["slope"] for r in L.partial_dependence(model, df, features, {"a": "up", "b": "up"}, points=3).collect()}
    for f in ("a", "b"):
        lo, hi = df.select(F.percentile(f, F.lit(0.05)), F.percentile(f, F.lit(0.95))).first()
        at = [lo + (hi - lo) * i / 2 for i in range(3)]
        means = [L.predict(model, df.withColumn(f, F.lit(v)), features).agg(F.avg("y_prob")).first()[0] for v in at]
        assert got[f] == pytest.approx(np.polyfit(at, means, 1)[0], abs=1e-9)
    model.write().save(str(tmp_path / "m"))
    again = L.PipelineModel.load(str(tmp_path / "m"))
    probability = lambda m: {r[0]: r[1] for r in m.transform(L.with_inputs(df, features)).select("id", vector_to_array("probability")[1]).collect()}
    assert probability(again) == probability(model)


def test_merged_fits_run_side_by_side():
    assert L.room(L.held(50 * L.ROWS_AT_ONCE), 8) == 8 and L.held(7) == 7
