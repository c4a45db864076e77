"""Queries: roll-ups, catalogs, drivers and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions.guards import per_thousand, ratio
from ..operators import evaluation as E
from ..operators import orderstats, scenario, serving
from ..operators.concentration import top_k_rows
from ..plans.domain import Domain
from ..session import stored
from ..sources.sinks import parsed_features
from .evaluation import _auc_sql
from .registry import query, rounded
from .sources import place_features

MODELS = ["m1_h3", "m1_h6", "m2_h3", "m2_h6"]
NUMERIC = ["n_lenders", "n_loans", "amount_k", "n_small", "is_rural", "population"]
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT tract_fips, county_fips, state_fips, population, '{c}' AS feature, {c}::DOUBLE AS value FROM d_features WHERE {c} IS NOT NULL" for c in NUMERIC
) + ")"
SCOPED = LONG + ", scoped AS (SELECT *, 'ALL' AS scope FROM long UNION ALL SELECT *, CAST(state_fips AS VARCHAR) FROM long)"


def _long(d: Domain):
    return serving.to_long(d.features().withColumn("w", F.col("population")), ["tract_fips", "county_fips", "state_fips", "w"], NUMERIC)


def _scoped(long):
    """Each value in the national scope and in that of its state."""
    return long.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("state_fips").cast("string"))))


# ---------------------------------------------------------------- scalar functions


@query("f04_logit_sigmoid", """
    SELECT tract_fips, year, round(ln(p / (1 - p)), 6) AS z, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back
    FROM (SELECT *, least(greatest(y_prob * 1.2::DOUBLE - 0.1::DOUBLE, 0.0001), 0.9999) AS p FROM d_scored)""")
def _(d: Domain):
    z = R.logit(F.col("y_prob") * 1.2 - 0.1)
    return rounded(d.scored().select("tract_fips", "year", z.alias("z"), R.sigmoid(z).alias("back")))


POINTS = "(p - 1 / (1 + exp(-(ln(p / (1 - p)) - attribution)))) * 100"
DRIVEN = "driven AS (SELECT d.*, r.risk, r.population, least(greatest(r.risk, 0.0001), 0.9999) AS p FROM d_drivers d JOIN d_risks r USING (tract_fips, model))"


@query("f05_attribution_points", f"""WITH {DRIVEN} SELECT tract_fips, model, feature, round({POINTS}, 6) + 0.0 AS points FROM driven""")
def _(d: Domain):
    both = d.drivers().join(d.risks().select("tract_fips", "model", "risk"), ["tract_fips", "model"])
    return rounded(both.select("tract_fips", "model", "feature", R.attribution_points("risk", "attribution").alias("points")))


CATALOG = SCOPED + """, cat AS (SELECT scope, feature, count(*) AS n, quantile_cont(value, [i / 100.0::DOUBLE for i in range(1, 100)]) AS cuts
    FROM scoped GROUP BY ALL HAVING count(*) >= CASE WHEN scope = 'ALL' THEN 100 ELSE 25 END)"""


def _catalog(d: Domain):
    return serving.percentile_catalog(_long(d), "state_fips")


@query("a23_percentile_catalog", f"""WITH {CATALOG} SELECT scope, feature, n, round(cuts[1], 6) AS p1, round(cuts[25], 6) AS p25, round(cuts[50], 6) AS p50,
    round(cuts[90], 6) AS p90, round(cuts[99], 6) AS p99, round(list_sum(cuts), 4) AS total FROM cat""")
def _(d: Domain):
    cut = {f"p{i}": F.element_at("cutpoints", i) for i in (1, 25, 50, 90, 99)}
    total = F.aggregate("cutpoints", F.lit(0.0), lambda acc, v: acc + v)
    return rounded(_catalog(d).select("scope", "feature", "n", *[e.alias(n) for n, e in cut.items()], total.alias("total")), total=4)


@query("f06_feature_percentile", f"""WITH {CATALOG}
    SELECT l.tract_fips, l.scope, l.feature, CASE WHEN value <= cuts[1] THEN 1 WHEN value >= cuts[99] THEN 99
      ELSE round(k + (value - cuts[k]) / (cuts[k + 1] - cuts[k]), 5) END::DOUBLE AS percentile
    FROM (SELECT l.*, cuts, len(list_filter(cuts, lambda q: q <= value)) AS k FROM scoped l JOIN cat ON cat.feature = l.feature AND cat.scope = l.scope) l""")
def _(d: Domain):
    long = stored(_long(d), "long")
    cat = serving.percentile_catalog(long, "state_fips").select("scope", "feature", "cutpoints")
    return rounded(_scoped(long).join(cat, ["scope", "feature"]).select("tract_fips", "scope", "feature", R.cutpoint_percentile("value", "cutpoints").alias("percentile")), 5)


SHARES = SCOPED + """, kinds AS (SELECT feature, count(DISTINCT value) AS n_values, CAST(count(DISTINCT value) <= 12 AND bool_and(abs(value - round(value)) <= 1e-8) AS INTEGER) AS is_categorical FROM long GROUP BY 1),
    shares AS (SELECT scope, s.feature, CAST(round(value) AS BIGINT) AS value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY scope, s.feature) AS share
      FROM scoped s JOIN kinds k ON k.feature = s.feature AND k.is_categorical = 1 GROUP BY scope, s.feature, value)"""


@query("a24_categorical_features", f"WITH {SHARES} SELECT feature, n_values, is_categorical FROM kinds")
def _(d: Domain):
    return serving.categorical_features(_long(d))


@query("a24_category_shares", f"WITH {SHARES} SELECT scope, feature, value, n, round(share, 9) AS share FROM shares")
def _(d: Domain):
    return rounded(serving.category_shares(stored(_long(d), "long"), "state_fips"), 9)


@query("f07_category_position", f"""WITH {SHARES}, r AS (SELECT scope, feature, min(value) AS lo, max(value) AS hi FROM shares GROUP BY ALL)
    SELECT l.tract_fips, l.scope, l.feature, round(CASE WHEN hi = lo THEN 50 ELSE (value - lo) / (hi - lo) * 100 END, 6)::DOUBLE AS position,
      round((SELECT sum(s.share) FROM shares s WHERE s.scope = l.scope AND s.feature = l.feature AND s.value <= l.value) * 100, 6) AS percentile
    FROM scoped l JOIN r ON r.feature = l.feature AND r.scope = l.scope""")
def _(d: Domain):
    long = stored(_long(d), "long")
    cats = serving.category_shares(long, "state_fips").groupBy("scope", "feature").agg(
        F.sort_array(F.collect_list(F.struct("value", "share"))).alias("categories"))
    joined = _scoped(long).join(cats, ["scope", "feature"])
    return rounded(joined.select("tract_fips", "scope", "feature", R.category_position("value", "categories").alias("position"),
                                 R.category_percentile("value", "categories").alias("percentile")))


@query("f08_guarded_division", """
    SELECT tract_fips, year, CASE WHEN population > 0 THEN round(n_loans * 1000.0::DOUBLE / population, 6) END AS per_1k,
      CASE WHEN n_small > 0 THEN round(amount_k / n_small, 7) END AS per_small FROM d_panel""")
def _(d: Domain):
    return rounded(d.panel().select("tract_fips", "year", per_thousand("n_loans", "population").alias("per_1k"), ratio("amount_k", "n_small").alias("per_small")), per_small=7)


@query("f09_output_rounding", "SELECT o_orderkey, round(o_totalprice, 1) AS p1, round(o_totalprice / 7, 4) AS p4, round(o_totalprice / 7, 6) AS p6 FROM orders WHERE o_totalprice IS NOT NULL")
def _(d: Domain):
    t = F.col("o_totalprice")
    # one decimal of a two-decimal price can tie; the decimal cast gives both engines the same digits
    return d.table("orders").select("o_orderkey", F.round(t, 1).alias("p1"), F.round(t / 7, 4).alias("p4"), F.round(t / 7, 6).alias("p6"))


@query("f10_base_scalars", """
    SELECT p_partkey, upper(trim(p_name)) AS name, lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS code, p_type LIKE 'S%' AS starts, replace(p_name, ' ', '_') AS joined,
      round(ln(1 + p_retailprice), 6) AS log1p, least(greatest(p_retailprice, 950), 1500)::DOUBLE AS clipped, CAST(sign(p_size - 25) AS INTEGER) AS sgn, abs(p_size - 25) AS gap,
      p_size IN (1, 2, 3) AS small, p_size BETWEEN 10 AND 20 AS mid, coalesce(nullif(p_size, 25), 0) AS filled FROM part""")
def _(d: Domain):
    s, r = F.col("p_size"), F.col("p_retailprice")
    return rounded(d.table("part").select(
        "p_partkey", F.upper(F.trim("p_name")).alias("name"), F.lpad(F.col("p_partkey").cast("string"), 11, "0").alias("code"),
        F.col("p_type").startswith("S").alias("starts"), F.regexp_replace("p_name", " ", "_").alias("joined"), F.log1p(r).alias("log1p"),
        F.least(F.greatest(r, F.lit(950.0)), F.lit(1500.0)).alias("clipped"), F.signum(s - 25).cast("int").alias("sgn"), F.abs(s - 25).alias("gap"),
        s.isin(1, 2, 3).alias("small"), s.between(10, 20).alias("mid"), F.coalesce(F.nullif(s, F.lit(25)), F.lit(0)).alias("filled")))


# ---------------------------------------------------------------- roll-ups

COUNTY = """county AS (SELECT county_fips, state_fips, model, count(*) AS n_tracts, sum(population) AS population,
    CASE WHEN sum(population) FILTER (risk IS NOT NULL) > 0 THEN sum(risk * population) / sum(population) ELSE avg(risk) END AS risk FROM d_risks GROUP BY ALL)"""


@query("a19_county_rollup", f"WITH {COUNTY} SELECT county_fips, state_fips, model, n_tracts, population, round(risk, 6) AS risk, 0 AS unweighted_fallback FROM county")
def _(d: Domain):
    return rounded(serving.county_rollup(d.risks(), ["county_fips", "state_fips", "model"], ["risk"]))


@query("a20_wide_risks", "SELECT tract_fips, " + ", ".join(f"round(max(risk) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS) + " FROM d_risks GROUP BY 1")
def _(d: Domain):
    return rounded(serving.wide_risks(d.risks(), ["tract_fips"], "model", "risk", MODELS))


@query("a21_histogram", """
    SELECT m.model, CAST(b AS INTEGER) AS bin, count(r.risk) AS n FROM (SELECT DISTINCT model FROM d_risks) m CROSS JOIN range(10) g(b)
    LEFT JOIN d_risks r ON r.model = m.model AND least(floor(r.risk * 10), 9) = b GROUP BY ALL""")
def _(d: Domain):
    return serving.histogram(d.risks(), ["model"], "risk")


@query("a22_nested_means", f"""WITH {COUNTY},
    c AS (SELECT county_fips, state_fips, avg(risk) AS risk FROM county GROUP BY ALL),
    s AS (SELECT CAST(state_fips AS VARCHAR) AS area, count(*) AS n, avg(risk) AS risk FROM d_risks GROUP BY 1 HAVING count(*) >= 5)
    SELECT 'national' AS grain, 'tract' AS unit, 'ALL' AS area, count(*) AS n, round(avg(risk), 6) AS risk FROM d_risks
    UNION ALL SELECT 'national', 'county', 'ALL', count(*), round(avg(risk), 6) FROM c UNION ALL SELECT 'state', 'tract', area, n, round(risk, 6) FROM s
    UNION ALL SELECT 'state', 'county', CAST(state_fips AS VARCHAR), count(*), round(avg(risk), 6) FROM c WHERE CAST(state_fips AS VARCHAR) IN (SELECT area FROM s) GROUP BY state_fips""")
def _(d: Domain):
    risks = stored(d.risks(), "risks")
    county = serving.county_rollup(risks, ["county_fips", "state_fips", "model"], ["risk"]).groupBy("county_fips", "state_fips").agg(F.avg("risk").alias("risk"))
    return rounded(serving.nested_means(risks, county, "state_fips", ["risk"]))


@query("a25_county_feature_means", f"""WITH {LONG}
    SELECT county_fips, feature, round(CASE WHEN sum(coalesce(population, 0)) > 0 THEN sum(value * coalesce(population, 0)) / sum(coalesce(population, 0)) ELSE avg(value) END, 4) AS value
    FROM long GROUP BY ALL""")
def _(d: Domain):
    return rounded(serving.county_feature_means(_long(d), "county_fips", "w"), 4)


@query("a26_county_drivers", f"""WITH {DRIVEN},
    t AS (SELECT county_fips, model, sum(population) AS total FROM d_risks WHERE population IS NOT NULL GROUP BY ALL),
    v AS (SELECT county_fips, model, feature, sum(attribution * population) AS value, sum({POINTS} * population) AS points FROM driven WHERE population IS NOT NULL GROUP BY ALL),
    f AS (SELECT v.county_fips, v.model, feature, value / total AS value, points / total AS points,
            row_number() OVER (PARTITION BY v.county_fips, v.model ORDER BY abs(round(points / total, 6)) DESC, feature) AS rank FROM v JOIN t ON t.county_fips = v.county_fips AND t.model = v.model WHERE total > 0)
    SELECT county_fips, model, feature, round(value, 5) + 0.0 AS value, round(points, 5) + 0.0 AS points, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 3""")
def _(d: Domain):
    tracts = stored(d.risks().select("tract_fips", "model", "county_fips", "risk", "population"), "risks")
    drivers = stored(d.drivers().drop("county_fips", "state_fips"), "drivers")
    return rounded(serving.county_drivers(drivers, tracts, "county_fips", "tract_fips", k=3), 5)


@query("a27_feature_summary", f"""WITH {LONG} SELECT feature, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
    round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90 FROM long GROUP BY 1""")
def _(d: Domain):
    return rounded(serving.feature_summary(_long(d)), 4)


IMPORTANCE = "imp AS (SELECT 'F' || (state_fips + 1) AS fold, feature, avg(abs(attribution)) AS importance FROM d_drivers GROUP BY ALL)"


def _importance(d: Domain):
    return d.drivers().groupBy(F.concat(F.lit("F"), F.col("state_fips") + 1).alias("fold"), "feature").agg(F.avg(F.abs("attribution")).alias("importance"))


@query("a28_importance_rollup", f"WITH {IMPORTANCE} SELECT feature, round(avg(importance), 6) AS mean_importance, round(stddev_samp(importance), 6) AS std_importance, count(DISTINCT fold) AS n_folds FROM imp GROUP BY 1")
def _(d: Domain):
    return rounded(serving.importance_rollup(_importance(d), ["feature"]))


@query("p14_importance_by_family", f"""WITH {IMPORTANCE} SELECT CASE WHEN feature IN ('pct_poverty', 'population') THEN 'acs_demographics' ELSE 'other' END AS family, round(sum(importance), 6) AS importance FROM imp GROUP BY 1""")
def _(d: Domain):
    return rounded(_importance(d).groupBy(R.feature_family("feature").alias("family")).agg(F.sum("importance").alias("importance")))


@query("m14_normalized_gain", f"""WITH {IMPORTANCE}, s AS (SELECT *, importance / sum(importance) OVER (PARTITION BY fold) AS share FROM imp)
    SELECT feature, round(avg(share), 6) AS mean_gain, count(*) FILTER (importance > 0) AS folds_used FROM s GROUP BY 1""")
def _(d: Domain):
    return rounded(serving.normalized_gain(_importance(d)))


@query("a30_bounding_boxes", """
    SELECT county_fips, round(min(lon), 6) AS min_lon, round(min(lat), 6) AS min_lat, round(max(lon + CASE tract_fips % 3 WHEN 0 THEN 2.5 ELSE 1 END), 6) AS max_lon, round(max(lat + 1), 6) AS max_lat
    FROM d_places GROUP BY 1""")
def _(d: Domain):
    features = parsed_features(place_features(d)).select(F.element_at("f.properties", "GEOID").cast("long").alias("tract_fips"), serving.geometry_bounds("f.geometry").alias("box"))
    return rounded(serving.merged_bounds(features.join(d.places().select("tract_fips", "county_fips"), "tract_fips"), ["county_fips"]))


# ---------------------------------------------------------------- sorts and top-k


@query("o02_top_places", """
    WITH r AS (SELECT state_fips, model, tract_fips, risk, row_number() OVER (PARTITION BY state_fips, model ORDER BY risk DESC, tract_fips) AS rn FROM d_risks)
    SELECT state_fips, model, string_agg(CAST(tract_fips AS VARCHAR), ',' ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY ALL""")
def _(d: Domain):
    top = serving.top_places(d.risks(), ["state_fips"], "model", "risk", "tract_fips")
    return top.select("state_fips", "model", F.array_join(F.transform("top", lambda t: t["tract_fips"].cast("string")), ",").alias("top"))


@query("o03_top_in_selection", "SELECT tract_fips, round(risk, 6) AS risk FROM d_risks WHERE model = 'm1_h3' AND is_rural = 1 ORDER BY d_risks.risk DESC, tract_fips LIMIT 25")
def _(d: Domain):
    chosen = R.Selection(rural_only=True).predicate("state_fips", "is_rural", "is_rural", "risk")
    best = d.risks().where("model = 'm1_h3'").where(chosen).orderBy(F.desc("risk"), "tract_fips").limit(25)
    return rounded(best.select("tract_fips", "risk"))


@query("o04_extreme_states", f"""
    WITH src AS (SELECT state_fips, y_prob2 AS s, y_true AS y FROM d_scored), {_auc_sql('src', 'state_fips')},
    t AS (SELECT state_fips, avg(risk) AS mean FROM d_risks WHERE model = 'm1_h3' GROUP BY 1)
    SELECT * FROM (SELECT 'top_mean' AS list, state_fips, round(mean, 6) AS value FROM t ORDER BY mean DESC, state_fips LIMIT 6)
    UNION ALL SELECT * FROM (SELECT 'bottom_auc', state_fips, round(auc, 6) FROM m ORDER BY auc, state_fips LIMIT 5)""")
def _(d: Domain):
    means = d.risks().where("model = 'm1_h3'").groupBy("state_fips").agg(F.avg("risk").alias("value"))
    aucs = E.scores(d.scored(), ["state_fips"], score="y_prob2").select("state_fips", F.col("auc").alias("value"))
    top = means.orderBy(F.desc("value"), "state_fips").limit(6).select(F.lit("top_mean").alias("list"), "state_fips", "value")
    bottom = aucs.orderBy("value", "state_fips").limit(5).select(F.lit("bottom_auc").alias("list"), "state_fips", "value")
    return rounded(top.unionByName(bottom))


@query("o05_top_attributions", """
    SELECT tract_fips, model, feature, round(attribution, 10) + 0.0 AS attribution, CAST(row_number() OVER w AS INTEGER) AS rank FROM d_drivers WHERE feature <> 'population'
    WINDOW w AS (PARTITION BY tract_fips, model ORDER BY abs(attribution) DESC, feature) QUALIFY row_number() OVER w <= 2""")
def _(d: Domain):
    top = serving.top_attributions(d.drivers().drop("county_fips", "state_fips"), ["tract_fips", "model"], 2, ("population",))
    return rounded(top, 10)


@query("o07_latest_population", """
    WITH a AS (SELECT tract_fips, max_by(population, year) AS v FROM d_panel WHERE population IS NOT NULL GROUP BY 1),
    b AS (SELECT tract_fips, max_by(households::DOUBLE, vintage) AS v FROM d_demographics GROUP BY 1)
    SELECT coalesce(a.tract_fips, b.tract_fips) AS tract_fips, coalesce(a.v, b.v) AS population FROM a FULL JOIN b ON a.tract_fips = b.tract_fips""")
def _(d: Domain):
    survey = d.demographics().withColumn("population", F.col("households").cast("double"))
    return serving.latest_with_fallback(d.panel(), survey, "tract_fips", ("year", "vintage"), "population")


# ---------------------------------------------------------------- set operations


@query("u01_union_years", "SELECT 'branch' AS kind, branch_id AS id, year FROM d_branches UNION ALL SELECT 'tract', tract_fips, year FROM d_panel")
def _(d: Domain):
    a = d.branches().select(F.lit("branch").alias("kind"), F.col("branch_id").alias("id"), "year")
    return a.unionByName(d.panel().select(F.lit("tract").alias("kind"), "year", F.col("tract_fips").alias("id")))


@query("u02_set_algebra", """
    WITH a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A')
    SELECT 'both' AS part, id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'first', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
    UNION ALL SELECT 'second', id FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def _(d: Domain):
    items = d.table("lineitem")
    a = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    b = items.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    parts = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    out = [df.select(F.lit(name).alias("part"), "id") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("u04_feature_universe", "SELECT DISTINCT feature FROM d_drivers WHERE feature <> 'population'")
def _(d: Domain):
    lists = d.drivers().groupBy("tract_fips", "model").agg(F.collect_list("feature").alias("features"))
    return lists.select(F.explode("features").alias("feature")).where("feature <> 'population'").distinct()


# ---------------------------------------------------------------- scenarios

ABLATION = [("branch_access", -0.02), ("residualized_concentration", -0.06), ("mdi_mission_lender", 0.003), ("ssbci_state_policy", -0.004)]
MOVES = [("branches_within_5mi", 1.5), ("lender_hhi_tract_resid", -1.0), ("ssbci_active", 2.0), ("mdi_branches_within_25mi", 0.0)]
STRENGTH = """
    imp AS (SELECT feature, avg(abs(attribution)) AS importance FROM d_drivers GROUP BY 1),
    lev(feature, lever_group, polarity) AS (VALUES ('distance_to_nearest_bank_branch', 'branch_access', -1), ('branches_within_5mi', 'branch_access', 1),
      ('mdi_branches_within_25mi', 'mdi_mission_lender', 1), ('ssbci_active', 'ssbci_state_policy', 1), ('microloan_intermediary_within_25mi', 'microlender_ecosystem', 1),
      ('lender_hhi_tract_resid', 'residualized_concentration', -1)),
    abl(lever_group, delta_ap) AS (VALUES ('branch_access', -0.02::DOUBLE), ('residualized_concentration', -0.06), ('mdi_mission_lender', 0.003), ('ssbci_state_policy', -0.004)),
    x AS (SELECT l.*, importance, greatest(-coalesce(delta_ap, 0), 0) AS ap_drop, coalesce(importance, 0) AS i, sum(coalesce(importance, 0)) OVER (PARTITION BY l.lever_group) AS g, sum(coalesce(importance, 0)) OVER () AS t
      FROM lev l LEFT JOIN imp ON imp.feature = l.feature LEFT JOIN abl ON abl.lever_group = l.lever_group),
    strength AS (SELECT feature, lever_group, polarity, CASE WHEN importance IS NULL THEN 0 ELSE -polarity * (CASE WHEN ap_drop > 0.005 THEN least(0.42, ap_drop * 10) ELSE least(0.04, i / t * 0.16) END)
      * (CASE WHEN g > 0 THEN i / g ELSE 1 END) END::DOUBLE AS unit_effect FROM x)"""
EFFECT = STRENGTH + """,
    mv(feature, z) AS (VALUES ('branches_within_5mi', 1.5::DOUBLE), ('lender_hhi_tract_resid', -1.0), ('ssbci_active', 2.0), ('mdi_branches_within_25mi', 0.0)),
    eff AS (SELECT s.feature, unit_effect * z AS effect FROM strength s JOIN mv ON mv.feature = s.feature WHERE abs(z) >= 1e-6),
    after AS (SELECT r.*, 1 / (1 + exp(-(ln(p / (1 - p)) + (SELECT sum(effect) FROM eff) * CASE WHEN model LIKE 'm2%' THEN 1 ELSE 0.4::DOUBLE END))) AS risk_after
      FROM (SELECT *, least(greatest(risk, 0.0001), 0.9999) AS p FROM d_risks) r)"""


def _strengths(d: Domain):
    importance = stored(d.drivers().groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance")), "importance")
    ablation = d.spark.createDataFrame(ABLATION, "lever_group string, delta_ap double")
    return stored(scenario.lever_strengths(scenario.levers_frame(d.spark), importance, ablation), "levers")


def _effects(d: Domain):
    return scenario.lever_effects(_strengths(d), d.spark.createDataFrame(MOVES, "feature string, z double"))


@query("v01_lever_effects", f"WITH {STRENGTH} SELECT feature, lever_group, polarity, round(unit_effect, 6) + 0.0 AS unit_effect FROM strength")
def _(d: Domain):
    return rounded(_strengths(d))


@query("v02_scenario_risk", f"WITH {EFFECT} SELECT tract_fips, model, round(risk, 6) AS risk, round(risk_after, 6) AS risk_after FROM after")
def _(d: Domain):
    return rounded(scenario.apply_scenario(d.risks().select("tract_fips", "model", "risk"), _effects(d)))


@query("v03_adjusted_drivers", f"""WITH {EFFECT},
    u AS (SELECT tract_fips, model, feature, attribution FROM d_drivers UNION ALL
          SELECT p.tract_fips, p.model, e.feature, e.effect * CASE WHEN model LIKE 'm2%' THEN 1 ELSE 0.4::DOUBLE END FROM (SELECT DISTINCT tract_fips, model FROM d_drivers) p, eff e),
    s AS (SELECT tract_fips, model, feature, round(sum(attribution), 9) AS a FROM u GROUP BY ALL)
    SELECT tract_fips, model, feature, round(a, 6) + 0.0 AS attribution, CAST(row_number() OVER w AS INTEGER) AS rank FROM s
    WINDOW w AS (PARTITION BY tract_fips, model ORDER BY abs(a) DESC, feature) QUALIFY row_number() OVER w <= 3""")
def _(d: Domain):
    return rounded(scenario.adjusted_drivers(d.drivers(), _effects(d), ["tract_fips", "model"], k=3))


@query("v04_threshold_crossings", f"""WITH {EFFECT} SELECT model, count(*) AS n, count(*) FILTER (risk_after >= 0.3 AND risk < 0.3) AS n_up, count(*) FILTER (risk_after < 0.3 AND risk >= 0.3) AS n_down,
    count(*) FILTER (risk_after >= 0.3 AND risk < 0.3) - count(*) FILTER (risk_after < 0.3 AND risk >= 0.3) AS net FROM after GROUP BY 1""")
def _(d: Domain):
    return scenario.crossings(scenario.apply_scenario(d.risks(), _effects(d)), ["model"], 0.3)


@query("v05_lever_summary", f"""WITH {STRENGTH}, s AS (SELECT feature, lever_group, (1 / (1 + exp(-(ln(0.1::DOUBLE / 0.9::DOUBLE) + unit_effect * 2))) - 0.1::DOUBLE) * 100 AS dp FROM strength)
    SELECT feature, lever_group, round(dp, 6) + 0.0 AS delta_points, CASE WHEN round(dp, 9) >= 0 THEN 'increases' ELSE 'decreases' END AS direction,
      CASE WHEN abs(dp) >= 2 THEN 'clear' WHEN abs(dp) >= 0.75 THEN 'modest' ELSE 'small' END AS strength FROM s WHERE abs(dp) > 1e-9""")
def _(d: Domain):
    return rounded(scenario.lever_summary(_strengths(d).where("abs(unit_effect) > 1e-9")))


@query("v06_selection_statistics", f"""
    WITH sel AS (SELECT * FROM d_scored WHERE state_fips = 2 AND (population IS NULL OR population >= 500)), src AS (SELECT y_prob AS s, y_true AS y FROM sel), {_auc_sql('src', '')}
    SELECT n, round((SELECT avg(y_prob) FROM sel), 6) AS mean_risk, round((SELECT max(y_prob) FROM sel), 6) AS max_risk, round(pos_rate, 6) AS pos_rate, CASE WHEN n > 50 THEN round(auc, 6) END AS auc FROM m""")
def _(d: Domain):
    chosen = R.Selection(state=2, ranges={"population": (500.0, 10000.0, 10000.0)}).predicate("state_fips", "is_rural", "is_rural", "y_prob")
    sel = stored(d.scored().where(chosen), "selection")
    mean, top = (sel.agg(f("y_prob")).scalar() for f in (F.avg, F.max))
    metrics = E.scores(sel, []).select("n", "pos_rate", F.when(F.col("n") > 50, F.col("auc")).alias("auc"))
    return rounded(metrics.select("*", mean.alias("mean_risk"), top.alias("max_risk")))


@query("v07_state_payload")
def _(d: Domain):
    from ..plans.dashboard import state_documents

    return state_documents(d)


@query("v08_driver_rows", f"""WITH {CATALOG}, {DRIVEN},
    t AS (SELECT *, row_number() OVER (PARTITION BY tract_fips, model ORDER BY abs(attribution) DESC, feature) AS rn FROM driven),
    j AS (SELECT t.tract_fips, t.model, l.scope, t.feature, {POINTS} AS points, l.value, cuts, len(list_filter(cuts, lambda q: q <= l.value)) AS k FROM t
      JOIN scoped l ON l.tract_fips = t.tract_fips AND l.feature = t.feature JOIN cat ON cat.feature = t.feature AND cat.scope = l.scope WHERE rn <= 8),
    q AS (SELECT *, CASE WHEN value <= cuts[1] THEN 1 WHEN value >= cuts[99] THEN 99 ELSE k + (value - cuts[k]) / (cuts[k + 1] - cuts[k]) END::DOUBLE AS pct FROM j)
    SELECT tract_fips, model, scope, feature, round(points, 5) + 0.0 AS points, value, round(pct, 4) AS percentile, CASE WHEN pct < 50 THEN 'bad' WHEN pct > 50 THEN 'good' ELSE 'neutral' END AS colour FROM q""")
def _(d: Domain):
    long = stored(_long(d), "long")
    cat = serving.percentile_catalog(long, "state_fips").select("scope", "feature", "cutpoints")
    top = top_k_rows(d.drivers().withColumn("size", F.abs("attribution")), ["tract_fips", "model"], "size", "feature", 8)
    rows = (
        top.join(d.risks().select("tract_fips", "model", "risk"), ["tract_fips", "model"])
        .join(_scoped(long).select("tract_fips", "scope", "feature", "value"), ["tract_fips", "feature"]).join(cat, ["scope", "feature"])
        .withColumn("percentile", R.cutpoint_percentile("value", "cutpoints"))
        .withColumn("points", R.attribution_points("risk", "attribution"))
    )
    return rounded(rows.select("tract_fips", "model", "scope", "feature", "points", "value", "percentile",
                               R.direction_class(R.direction_of("feature"), "percentile").alias("colour")), 4, points=5)


@query("v09_search_index", """
    SELECT n_name || ', ' || r_name AS label, p.county_fips, min_lon, min_lat, max_lon, max_lat FROM
      (SELECT county_fips, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM d_places GROUP BY 1) p
      JOIN nation ON n_nationkey = p.county_fips JOIN region ON r_regionkey = n_regionkey""")
def _(d: Domain):
    point = F.array(F.array(F.array("lon", "lat")))
    boxes = serving.merged_bounds(d.places().select("county_fips", serving.ring_bounds(point).alias("box")), ["county_fips"])
    names = d.table("nation").join(d.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("county_fips"), F.concat_ws(", ", "n_name", "r_name").alias("label"))
    return boxes.join(names, "county_fips").orderBy("label")
