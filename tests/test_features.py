"""Feature operators on literal rows and against small reference computations."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tractloom.functions import cleaning as C
from tractloom.functions import guards as U
from tractloom.functions import risk as R
from tractloom.operators import checks, cohorts, concentration, crosswalk, matching, rollups, temporal
from tractloom.functions.names import normalize_name, token_set, token_set_score


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "x string")
    return tuple(df.select(*[c(F.col("x")).alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize("raw,want", [("12.03", "001203"), (" 4001 ", "004001"), ("NA", None), ("na", None), ("", None), ("1234567", None), ("12a", None), (None, None)])
def test_normalize_tract(spark, raw, want):
    assert one(spark, raw, C.normalize_tract) == (want,)


@pytest.mark.parametrize("raw,i,f", [("12", 12, 12.0), (" -3 ", -3, -3.0), ("1.5", 0, 1.5), ("x", 0, 0.0), ("", 0, 0.0), (None, 0, 0.0), ("--5", 0, 0.0)])
def test_permissive_casts(spark, raw, i, f):
    assert one(spark, raw, C.to_int, C.to_float) == (i, f)


@pytest.mark.parametrize("raw,want", [("2020-03-01", 2020), ("03/01/2019", 2019), ("3/1/19", None), ("n/a", None), ("", None), (None, None), ("x-1", None)])
def test_year_of_date(spark, raw, want):
    assert one(spark, raw, C.year_of_date) == (want,)


@pytest.mark.parametrize("raw,want", [("$1,234.50", 1234.5), ("", 0.0), ("free", 0.0), (None, 0.0)])
def test_money(spark, raw, want):
    assert one(spark, raw, C.money) == (want,)


def test_sentinels_and_stubs(spark):
    assert one(spark, "-666666666", C.census_number) == (None,)
    assert one(spark, "51.5", C.census_number) == (51.5,)
    assert one(spark, "\n  <html>", C.is_html_stub) == (True,)
    assert one(spark, "a,b\n<", C.is_html_stub) == (False,)
    assert one(spark, "123.0", C.strip_decimal) == ("123",)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int")
    assert U.nan_to_null(df).agg(F.avg("v")).first()[0] == 2.0


def test_keys_must_be_unique(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        checks.require_unique(df, ["k"], "table")
    with pytest.raises(Exception, match="duplicate key"):
        checks.guarded_unique(df, ["k"], "table").collect()


def test_concentration_gate_and_hot_place(spark):
    rows = [("t", 2000, f"l{i}", 1 + i % 5, 1, 0) for i in range(1500)] + [("u", 2000, "a", 3, 1, 1), ("u", 2000, "b", 1, 0, 0), ("z", 2000, "a", 0, 0, 0), ("z", 2000, "b", 0, 0, 0), ("z", 2000, "c", 0, 0, 0)]
    df = spark.createDataFrame(rows, "tract_fips string, year int, lender_id string, n_loans int, count_lt_100 int, count_100_250 int")
    got = {r["tract_fips"]: r for r in concentration.concentration(df).collect()}
    n = np.array([r[3] for r in rows if r[0] == "t"], dtype=float)
    assert got["t"]["lender_hhi_tract"] == pytest.approx(((n / n.sum()) ** 2).sum())
    assert got["t"]["top3_lender_share_tract"] == pytest.approx(15 / n.sum())
    assert got["u"]["lender_hhi_tract"] is None and got["u"]["pct_loans_under_250k"] == pytest.approx(0.5)
    assert got["z"]["lender_hhi_tract"] == 0.0 and got["z"]["pct_loans_under_100k"] is None


def test_lender_mix_unknown_flag_stays_in_denominator(spark):
    fact = spark.createDataFrame([("t", 1, "a", 2.0), ("t", 1, "b", 1.0), ("t", 1, "c", 1.0)], "tract_fips string, year int, lender_id string, n_loans double")
    flags = spark.createDataFrame([("a", 1, 1), ("b", 1, None)], "lender_id string, year int, f int")
    assert concentration.lender_mix(fact, flags, {"f": "share"}).first()["share"] == 0.5


def test_trailing_mean_counts_rows_and_calendar_lag_counts_years(spark):
    df = spark.createDataFrame([("t", y, float(v)) for y, v in [(2000, 0), (2001, 1), (2003, 3), (2004, 4), (2005, 5), (2006, 6), (2007, 7)]], "p string, year int, v double")
    got = [r["v_lag2to5_mean"] for r in temporal.trailing_mean(df, "p", "year", ["v"], 2, 5).orderBy("year").collect()]
    assert got == [None, None, 0.0, 0.5, 4 / 3, 2.0, 3.25]
    lag = {r["year"]: r["v_m1"] for r in temporal.by_calendar_year(df, "p", "year", ["v"], [-1]).collect()}
    assert lag[2003] is None and lag[2004] == 3.0


def test_asof_has_no_fallback(spark):
    panel = spark.createDataFrame([("a", 2012), ("b", 2012), ("a", 2010)], "tract_fips string, year int")
    v = spark.createDataFrame([("a", 2009, 1.0), ("a", 2010, 2.0), ("b", 2009, 9.0)], "tract_fips string, vintage int, x double")
    got = {(r["tract_fips"], r["year"]): (r["vintage"], r["x"]) for r in temporal.asof_vintage(panel, v).collect()}
    assert got == {("a", 2012): (2010, 2.0), ("b", 2012): (2010, None), ("a", 2010): (None, None)}


def test_lagged_sums_keep_early_years(spark):
    df = spark.createDataFrame([("t", 2000, 5.0), ("t", 2006, 1.0)], "p string, year int, v double")
    got = {r["year"]: r["s"] for r in temporal.lagged_sums(df, "p", "year", {"s": ("v", 2, 6)}).collect()}
    assert got == {2000: None, 2001: None, 2002: 5.0, 2003: 5.0, 2004: 5.0, 2005: 5.0, 2006: 5.0}


def test_forward_labels(spark):
    df = spark.createDataFrame([("t", 2000, 0), ("t", 2001, 1), ("t", 2003, 0)], "p string, year int, f int")
    got = {r["year"]: (r["state_f_h1"], r["becomes_f_h1"], r["state_f_h2"]) for r in temporal.forward_labels(df, "p", "year", ["f"], [1, 2]).collect()}
    assert got == {2000: (1, 1, None), 2001: (None, None, 0), 2003: (None, None, None)}


def test_churn_with_gaps(spark):
    rows = [("t", "a", 2000), ("t", "b", 2000), ("t", "b", 2001), ("t", "c", 2001), ("t", "a", 2003), ("t", "b", 2003)]
    got = {r["year"]: r for r in concentration.entity_churn(spark.createDataFrame(rows, "tract_fips string, lender_id string, year int")).collect()}
    assert (got[2001]["entries_1yr"], got[2001]["exits_1yr"], got[2001]["churn_1yr"], got[2001]["retention_1yr"]) == (1, 1, 2, 0.5)
    assert (got[2003]["entries_1yr"], got[2003]["exits_1yr"], got[2003]["retention_1yr"]) == (2, 0, None)
    assert (got[2003]["entries_3yr"], got[2003]["churn_3yr"], got[2003]["retention_3yr"]) == (0, 0, 1.0)


def test_residuals_are_least_squares(spark):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 40, 400)
    pdf = pd.DataFrame({"id": range(400), "c": np.where(np.arange(400) < 330, "big", np.where(np.arange(400) < 370, "small", "flat")), "n": n})
    pdf.loc[pdf["c"] == "flat", "n"] = 7
    extra = pd.DataFrame({"id": range(400, 460), "c": "flat", "n": 7})
    pdf = pd.concat([pdf, extra], ignore_index=True)
    pdf["y"] = 3 + 2 * np.log1p(pdf["n"]) - 0.1 * pdf["n"] + rng.normal(0, 1, len(pdf))
    pdf.loc[pdf["id"] % 10 == 0, "y"] = None
    df = spark.createDataFrame(pdf, "id long, c string, n int, y double").replace(float("nan"), None)
    got = cohorts.residualize(df, ["c"], ["y"], "n").toPandas().set_index("id")
    assert got[got["c"] == "small"]["y_resid"].isna().all()
    for c in ("big", "flat"):
        part = pdf[(pdf["c"] == c) & pdf["y"].notna()]
        x = np.column_stack([np.ones(len(part)), np.log1p(part["n"]), part["n"]])
        want = part["y"] - x @ np.linalg.lstsq(x, part["y"], rcond=None)[0]
        np.testing.assert_allclose(got.loc[part["id"], "y_resid"], want, atol=1e-7)


def test_crosswalk_composition_and_precedence(spark):
    s = "src string, dst string, weight double"
    ab = spark.createDataFrame([("a", "m", 0.5), ("a", "n", 0.5), ("q", "m", 1.0)], s)
    bc = spark.createDataFrame([("m", "x", 0.25), ("m", "y", 0.75), ("q", "z", 2.0)], s)
    composed = {(r["src"], r["dst"]): r["weight"] for r in crosswalk.compose(ab, bc).collect()}
    assert composed == {("a", "x"): 0.125, ("a", "y"): 0.375, ("a", "n"): 0.5, ("q", "x"): 0.25, ("q", "y"): 0.75}
    unified = {(r["src"], r["dst"]): r["weight"] for r in crosswalk.unify(bc, crosswalk.compose(ab, bc)).collect()}
    assert unified[("q", "z")] == 1.0 and ("q", "x") not in unified and unified[("a", "n")] == 0.5


def test_reaggregate_weights_known_rates_only(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 1.0, 5.0), ("b", 1, 10.0, None, 5.0)], "k string, year int, n double, r double, pop double")
    xw = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 1.0)], "src string, dst string, weight double")
    assert crosswalk.reaggregate(df, xw, "k", ["year"], ["n"], ["r"], "pop").first()["r"] == 1.0
    old = crosswalk.reaggregate(df, xw, "k", ["year"], ["n"], ["r"], "pop", weight_all_rows=True).first()
    assert old["r"] == 0.5 and old["n"] == 20.0


def test_apportion_zero_when_no_totals(spark):
    p = spark.createDataFrame([("c", "l", 1, "t1"), ("c", "l", 1, "t2"), ("c", "l", 1, "t2"), ("c", "m", 1, "t1")], "county_fips string, lender_id string, year int, tract_fips string")
    t = spark.createDataFrame([("c", "l", 1, 3, 30.0, 0, 0.0, 1, 7.0)], "county_fips string, lender_id string, year int, " + ", ".join(f"{b} double" if b.startswith("a") else f"{b} long" for b in rollups.BUCKETS))
    got = {(r["tract_fips"], r["lender_id"]): (r["n_loans"], r["amount_k"]) for r in rollups.apportion(p, t).collect()}
    assert got == {("t1", "l"): (2.0, 18.5), ("t2", "l"): (2.0, 18.5), ("t1", "m"): (0.0, 0.0)}


def test_fuzzy_candidates_lose_nothing(spark):
    rng = random.Random(4)
    words = ["first", "merchants", "merchant", "farmers", "farmer", "citizens", "united", "valley", "river", "state", "x", "ab"]

    def name():
        w = rng.sample(words, rng.randint(1, 3))
        s = " ".join(w)
        if rng.random() < 0.5:
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice(["", "z", s[i] * 2]) + s[i + 1:]
        return " ".join(s.split())

    left = spark.createDataFrame([("s", name()) for _ in range(120)], "state string, n string")
    right = spark.createDataFrame([("s", name()) for _ in range(120)], "state string, n string")
    score = token_set_score(token_set("n"), token_set("other"))
    everything = left.distinct().join(right.distinct().withColumnRenamed("n", "other"), "state").where("n <> '' and other <> ''").withColumn("score", score).cache()
    for threshold in (75.0, 90.0):
        want = {(r["n"], r["other"]) for r in everything.where(F.col("score") >= threshold - 1e-9).collect()}
        got = {(r["n"], r["other"]) for r in matching.scored_pairs(left, right, ["state"], "n", threshold).collect()}
        assert got == want and want


def test_names(spark):
    assert one(spark, "The First Nat'l Bank & Trust, N.A.", normalize_name)[0] == "first nat l n"
    df = spark.createDataFrame([("b a", "a b c")], "p string, q string")
    assert df.select(token_set_score(token_set("p"), token_set("q"))).first()[0] == 100.0


def test_risk_functions(spark):
    cuts = [float(i) for i in range(1, 100)]
    df = spark.createDataFrame([(v, cuts) for v in (-5.0, 1.0, 50.25, 99.0, 1000.0, None)], "v double, cuts array<double>")
    assert [r[0] for r in df.select(R.cutpoint_percentile("v", "cuts")).collect()] == [1.0, 1.0, 50.25, 99.0, 99.0, None]
    z = spark.createDataFrame([(800.0,), (-800.0,), (0.0,)], "z double").select(R.sigmoid("z")).collect()
    assert [r[0] for r in z] == [1.0, 0.0, 0.5]
    d = spark.createDataFrame([(0.06, 0.01), (0.01, 0.06), (0.06, 0.2), (0.001, 0.019), (0.05, 0.06), (None, 0.5), (0.03, 0.06)], "a double, b double")
    assert [r[0] for r in d.select(R.divergence_label("a", "b")).collect()] == ["first_higher", "second_higher", "both_elevated", "both_low", None, None, "mixed"]


def test_selection_lets_unknown_pass(spark):
    df = spark.createDataFrame([(1, 1, 0, None, 0.5), (2, 1, 0, 99.0, 0.5), (3, 1, 0, 5.0, None), (4, 1, 0, 5.0, 0.5)], "id int, st int, ru int, pop double, risk double")
    s = R.Selection(state=1, ranges={"pop": (0.0, 50.0, 100.0)}, min_risk_pct=10.0)
    assert [r["id"] for r in df.where(s.predicate("st", "ru", "ru", "risk")).orderBy("id").collect()] == [1, 4]
    unbounded = R.Selection(ranges={"pop": (0.0, 100.0, 100.0)})
    assert df.where(unbounded.predicate("st", "ru", "ru", "risk")).count() == 4
