"""Parts, tasks and fits stay bounded where the tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.catalog import features as C
from tractloom.operators import evaluation as E
from tractloom.operators import learning as L
from tractloom.plans import domain
from tractloom.plans.domain import Domain


@pytest.fixture
def tables(spark, tmp_path):
    def put(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put([(i, 0, "BUILDING", 1.0) for i in range(40)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double", "customer")
    put([(0, 0)], "n_nationkey int, n_regionkey int", "nation")
    put([(i, i % 45 if i % 9 else None, f"199{i % 3 + 5}-01-01") for i in range(200)], "o_orderkey long, o_custkey long, d string", "orders_text")
    spark.read.parquet(f"{tmp_path}/orders_text.parquet").select("o_orderkey", "o_custkey", F.to_date("d").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    put([(i % 200, i % 7, float(i)) for i in range(1000)], "l_orderkey long, l_suppkey long, l_extendedprice double", "lineitem")
    put([(i, 100.0 * i, i) for i in range(7)], "s_suppkey long, s_acctbal double, s_nationkey int", "supplier")
    return Domain(spark, str(tmp_path))


def test_fact_is_dealt_in_parts_of_bounded_size(spark, tables, monkeypatch):
    monkeypatch.setattr(domain, "LOANS_IN_PART", 100)
    assert tables.parts(100) == 10
    plan = tables.fact()._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert tables.fact().groupBy("tract_fips", "year").count().count() > 0


def test_lender_totals_equal_those_of_the_fact(tables):
    of_fact = tables.fact().groupBy("lender_id", "year").agg(F.sum("amount_k").alias("amount_k"))
    key = lambda df: sorted((r["lender_id"], r["year"], r["amount_k"]) for r in df.collect())
    assert key(tables.lender_totals()) == key(of_fact)


def test_flags_read_the_loans_once(spark, tables):
    flags = C._lender_flags(tables)
    assert not any("lineitem" in f for f in flags.inputFiles())
    assert flags.count() == tables.fact().select("lender_id", "year").distinct().count()


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), None if i % 13 == 0 else float(b), int(a + b > 0.3)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").coalesce(2)
    return df, L.fit_trees(df.where("id < 300"), df.where("id >= 300"), ["a", "b"], "y", L.Settings(rounds=3, depth=2, feature_share="all", first_rounds=3, patience=2))


def test_rows_that_no_tree_tells_apart_are_scored_once(spark, model):
    df, fitted = model
    prepare, assembler, trees = fitted.stages
    rows = prepare.transform(L.with_inputs(df, ["a", "b"])).withColumn("__y", F.col("y").cast("double"))
    groups = L.alike(trees, rows, assembler.getInputCols(), [], ["__y"]).cache()
    assert groups.count() < 200 and groups.agg(F.sum("__n")).first()[0] == 400
    whole = L.prefix_probabilities(trees, assembler.transform(rows), ["__y"])
    merged = L.prefix_probabilities(trees, assembler.transform(groups), ["__y", "__n"])
    one = {r["prefix"]: r for r in E.scores(whole, ["prefix"], "__y").collect()}
    two = {r["prefix"]: r for r in E.scores(merged, ["prefix"], "__y", weight="__n").collect()}
    assert one.keys() == two.keys()
    for n, r in one.items():
        assert two[n].asDict() == pytest.approx(r.asDict(), abs=1e-12)
    later = L.prefix_probabilities(trees, assembler.transform(groups), [], after=1).select("prefix").distinct().collect()
    assert {r[0] for r in later} == {n for n in one if n > 1}


def test_dependence_equals_the_mean_over_all_rows(spark, model):
    df, fitted = model
    got = {r["feature"]: r["slope"] for r in L.partial_dependence(fitted, df, ["a", "b"], {"a": "up", "b": "up"}, points=3).collect()}
    for f in ("a", "b"):
        lo, hi = df.select(F.percentile(f, F.lit(0.05)), F.percentile(f, F.lit(0.95))).first()
        at = [lo + (hi - lo) * i / 2 for i in range(3)]
        means = [L.predict(fitted, df.withColumn(f, F.lit(x)), ["a", "b"]).agg(F.avg("y_prob")).first()[0] for x in at]
        assert got[f] == pytest.approx(np.polyfit(at, means, 1)[0], abs=1e-9)


def test_large_fits_run_one_after_another():
    assert L.room(1000, 8) == 8 and L.room(L.ROWS_AT_ONCE, 8) == 1 and L.room(10 * L.ROWS_AT_ONCE, 8) == 1 and L.room(0, 4) == 4


def test_trials_share_their_inputs(spark, monkeypatch):
    """All trials of a search read the same rows: medians are learned once, and each trial equals a fit of its own."""
    rng = np.random.default_rng(5)
    rows = [(i, 1995 + i % 2, float(a) if i % 7 else None, float(b), int(a + b > 1)) for i, (a, b) in enumerate(rng.random((400, 2)))]
    panel = spark.createDataFrame(rows, "id long, year int, a double, b double, y int").coalesce(1)
    fits, real = [], L.Imputer.fit
    monkeypatch.setattr(L.Imputer, "fit", lambda self, *x: fits.append(1) or real(self, *x))
    base = L.Settings(rounds=3, depth=3, first_rounds=3, patience=2, feature_share="all")
    found = sorted(L.tune(panel, ["a", "b"], "y", ("f", 1995, 1995, 1996, 1996, 1996), trials=3, base=base).collect(), key=lambda r: r["trial"])
    assert len(found) == 3 and len(fits) == 1
    one = found[0]
    alone = L.replace(base, depth=one["depth"], rate=one["rate"], subsample=one["subsample"], min_rows=one["min_rows"])
    train, val = panel.where("year = 1995"), panel.where("year = 1996")
    model = L.fit_trees(train, val, ["a", "b"], "y", alone)
    again = E.scores(L.predict(model, val, ["a", "b"]), [], "y").first()
    assert len(model.stages[-1].treeWeights) == one["rounds"] and again["ap"] == pytest.approx(one["ap"], abs=1e-12)
