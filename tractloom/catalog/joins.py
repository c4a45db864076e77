"""Queries: panel joins, as-of vintages, crosswalks, proximity, peers and entity matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.names import normalize_name
from ..operators import cohorts, crosswalk, evaluation, matching, peers, rollups, serving, spatial, temporal
from ..operators.checks import left_attach
from ..plans.domain import Domain
from ..session import stored
from .registry import query, rounded


@query("j01_panel_join_chain", """
    SELECT p.tract_fips, p.year, p.n_lenders, p.population, c.n_branches, round(c.deposits, 2) AS deposits, x.n_loans_zip
    FROM d_panel p LEFT JOIN (SELECT county_fips, year, count(*) AS n_branches, sum(deposits) AS deposits FROM d_branches GROUP BY ALL) c
           ON c.county_fips = p.county_fips AND c.year = p.year
         LEFT JOIN (SELECT zip, year, count(*) AS n_loans_zip FROM d_loans GROUP BY ALL) x ON x.zip = p.tract_fips AND x.year = p.year""")
def _(d: Domain):
    county = d.branches().groupBy("county_fips", "year").agg(
        F.count(F.lit(1)).alias("n_branches"), F.sum("deposits").alias("deposits"), F.lit(-1.0).alias("population"))
    loans = d.loans().groupBy(F.col("zip").alias("tract_fips"), "year").agg(F.count(F.lit(1)).alias("n_loans_zip"))
    out = left_attach(d.panel(), county, ["county_fips", "year"], "county table", unique=True)
    out = left_attach(out, loans, ["tract_fips", "year"], "loan table", unique=True)
    return rounded(out.select("tract_fips", "year", "n_lenders", "population", "n_branches", "deposits", "n_loans_zip"), 2)


@query("j02_county_and_tract_grain", """
    SELECT p.tract_fips, p.year, m.n_counties, a.n_applications, CAST(p.year >= 1998 AS INTEGER) AS has_applications
    FROM d_panel p LEFT JOIN (SELECT county_fips, year, count(DISTINCT lender_id) AS n_counties FROM d_fact GROUP BY ALL) m
           ON m.county_fips = p.county_fips AND m.year = p.year
         LEFT JOIN (SELECT tract_fips, count(*) AS n_applications FROM d_applications GROUP BY ALL) a ON a.tract_fips = p.tract_fips""")
def _(d: Domain):
    county = d.fact().groupBy("county_fips", "year").agg(F.count_distinct("lender_id").alias("n_counties"))
    apps = d.applications().groupBy("tract_fips").agg(F.count(F.lit(1)).alias("n_applications"))
    out = left_attach(d.panel(), county, ["county_fips", "year"], "county table", unique=True)
    out = left_attach(out, apps, ["tract_fips"], "applications", unique=True)
    return out.select("tract_fips", "year", "n_counties", "n_applications", (F.col("year") >= 1998).cast("int").alias("has_applications"))


@query("j03_asof_vintage", """
    WITH v AS (SELECT DISTINCT vintage FROM d_demographics),
    y AS (SELECT y.year, max(v.vintage) AS vintage FROM (SELECT DISTINCT year FROM d_panel) y LEFT JOIN v ON v.vintage <= y.year - 2 GROUP BY 1)
    SELECT p.tract_fips, p.year, y.vintage, round(m.income, 7) AS income, m.households
    FROM d_panel p JOIN y ON y.year = p.year LEFT JOIN d_demographics m ON m.tract_fips = p.tract_fips AND m.vintage = y.vintage""")
def _(d: Domain):
    out = temporal.asof_vintage(d.panel().select("tract_fips", "year"), d.demographics())
    return rounded(out.select("tract_fips", "year", "vintage", "income", "households"), 7)


@query("j04_apportion", """
    WITH pres AS (SELECT DISTINCT county_fips, lender_id, year, tract_fips FROM d_fact),
    n AS (SELECT county_fips, lender_id, year, count(*) AS n FROM pres GROUP BY ALL),
    tot AS (SELECT county_fips, lender_id, year, sum(count_lt_100) AS c1, sum(amount_lt_100) AS a1, sum(count_100_250) AS c2, sum(amount_100_250) AS a2,
              sum(count_250_1m) AS c3, sum(amount_250_1m) AS a3 FROM d_fact WHERE county_fips <> 7 GROUP BY ALL)
    SELECT p.tract_fips, p.county_fips, p.lender_id, p.year,
      round((coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3, 0)) / n, 9) AS n_loans, round(coalesce(c1, 0) / n, 9) AS count_lt_100,
      round(coalesce(c2, 0) / n, 9) AS count_100_250, round(coalesce(c3, 0) / n, 9) AS count_250_1m, round(coalesce(a1, 0) / n, 6) AS amount_lt_100
    FROM pres p JOIN n ON n.county_fips = p.county_fips AND n.lender_id = p.lender_id AND n.year = p.year
      LEFT JOIN tot t ON t.county_fips = p.county_fips AND t.lender_id = p.lender_id AND t.year = p.year""")
def _(d: Domain):
    fact = d.fact()
    keys = ["county_fips", "lender_id", "year"]
    totals = rollups.bucket_totals(fact.where(F.col("county_fips") != 7), keys)  # one county without totals: counts as zero
    out = rollups.apportion(fact.select(*keys, "tract_fips"), totals, digits=(9, 6))
    return out.select("tract_fips", *keys, "n_loans", "count_lt_100", "count_100_250", "count_250_1m", "amount_lt_100")


UNIFIED = """
    composed AS (SELECT a.src, coalesce(b.dst, a.dst) AS dst, sum(a.weight * coalesce(b.weight, 1.0::DOUBLE)) AS weight
      FROM d_crosswalk_ab a LEFT JOIN d_crosswalk_bc b ON b.src = a.dst GROUP BY ALL),
    unified AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM (
      SELECT * FROM d_crosswalk_bc UNION ALL SELECT * FROM composed WHERE src NOT IN (SELECT src FROM d_crosswalk_bc)))"""


def _unified(d: Domain):
    return crosswalk.unify(d.crosswalk_bc(), crosswalk.compose(d.crosswalk_ab(), d.crosswalk_bc()))


@query("j05_crosswalk_fan_out", f"""WITH {UNIFIED}
    SELECT p.tract_fips AS source, p.year, coalesce(u.dst, p.tract_fips) AS tract_fips, round(p.n_loans * coalesce(u.weight, 1.0), 6) AS n_loans
    FROM d_panel p LEFT JOIN unified u ON u.src = p.tract_fips""")
def _(d: Domain):
    p = d.panel().select(F.col("tract_fips").alias("source"), "tract_fips", "year", "n_loans")
    out = crosswalk.fan_out(p, _unified(d), "tract_fips")
    return rounded(out.select("source", "year", "tract_fips", (F.col("n_loans") * F.col("__w")).alias("n_loans")))


@query("j06_crosswalk_compose", f"WITH {UNIFIED} SELECT src, dst, round(weight, 6) AS weight FROM composed")
def _(d: Domain):
    return rounded(crosswalk.compose(d.crosswalk_ab(), d.crosswalk_bc()))


@query("j07_crosswalk_unify", f"WITH {UNIFIED} SELECT src, dst, round(weight, 6) AS weight FROM unified")
def _(d: Domain):
    return rounded(_unified(d))


@query("a14_reaggregate", f"""WITH {UNIFIED},
    r AS (SELECT coalesce(u.dst, p.tract_fips) AS t, p.year, coalesce(u.weight, 1.0::DOUBLE) AS w, n_loans, population,
            CASE WHEN n_lenders >= 3 THEN amount_k / n_loans END AS mean_loan FROM d_panel p LEFT JOIN unified u ON u.src = p.tract_fips)
    SELECT t AS tract_fips, year, round(sum(n_loans * w), 4) AS n_loans,
      round(sum(mean_loan * coalesce(population, 0) * w) / nullif(sum(coalesce(population, 0) * w) FILTER (mean_loan IS NOT NULL), 0), 7) AS mean_loan
    FROM r GROUP BY ALL""")
def _(d: Domain):
    p = d.panel().withColumn("mean_loan", F.when(F.col("n_lenders") >= 3, F.col("amount_k") / F.col("n_loans")))
    out = crosswalk.reaggregate(p, _unified(d), "tract_fips", ["year"], ["n_loans"], ["mean_loan"], "population")
    return rounded(out, 4, mean_loan=7)


@query("j08_area_apportionment", """
    WITH tot AS (SELECT p_partkey AS area, p_retailprice AS amount, CAST(p_size AS BIGINT) AS loans FROM part),
    w AS (SELECT area, tract_fips, overlap / sum(overlap) OVER (PARTITION BY area) AS share FROM d_overlaps)
    SELECT w.tract_fips, round(sum(amount * share), 4) AS amount, round(sum(loans * share), 4) AS loans FROM w JOIN tot USING (area) GROUP BY ALL""")
def _(d: Domain):
    totals = d.table("part").select(F.col("p_partkey").alias("area"), F.col("p_retailprice").alias("amount"), F.col("p_size").cast("long").alias("loans"))
    return rounded(crosswalk.apportion_areas(totals, d.overlaps(), "area", "tract_fips", ["amount", "loans"]), 4)


@query("j20_dominant_area", """
    SELECT tract_fips, area, overlap FROM d_overlaps QUALIFY row_number() OVER (PARTITION BY tract_fips ORDER BY overlap DESC, area) = 1""")
def _(d: Domain):
    return crosswalk.dominant_area(d.overlaps(), "tract_fips", "area")


# ---------------------------------------------------------------- proximity

HAVERSINE = (
    "2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(b.lat - p.lat) / 2), 2)"
    " + cos(radians(p.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - p.lon) / 2), 2))))"
)


@query("f01_haversine", f"""
    SELECT p.tract_fips, round({HAVERSINE}, 6) AS miles FROM d_places p, (SELECT 39.0::DOUBLE AS lat, -95.5::DOUBLE AS lon) b""")
def _(d: Domain):
    return rounded(d.places().select("tract_fips", G.haversine_miles("lat", "lon", F.lit(39.0), F.lit(-95.5)).alias("miles")))


def _within(miles: float, margin: float) -> str:
    return f"""
      SELECT p.tract_fips, b.year, count(*) AS n FROM d_places p JOIN d_branches b
        ON b.lat BETWEEN p.lat - {margin} AND p.lat + {margin} AND {HAVERSINE} <= {miles} GROUP BY ALL"""


@query("j09_count_within", f"""
    WITH y AS (SELECT DISTINCT year FROM d_branches), w5 AS ({_within(5, 0.08)}), w25 AS ({_within(25, 0.37)})
    SELECT p.tract_fips, y.year, coalesce(w5.n, 0) AS branches_within_5mi, coalesce(w25.n, 0) AS branches_within_25mi
    FROM d_places p CROSS JOIN y LEFT JOIN w5 ON w5.tract_fips = p.tract_fips AND w5.year = y.year
      LEFT JOIN w25 ON w25.tract_fips = p.tract_fips AND w25.year = y.year""")
def _(d: Domain):
    places, branches = d.places(), stored(d.branches().select("branch_id", "year", "lat", "lon"), "branches")
    return spatial.counts_within(places, branches, {"branches_within_5mi": 5.0, "branches_within_25mi": 25.0}, by=["year"])


@query("j10_nearest", f"""
    SELECT p.tract_fips, b.year, round(min({HAVERSINE}), 6) AS nearest_miles FROM d_places p CROSS JOIN d_branches b GROUP BY ALL""")
def _(d: Domain):
    branches = stored(d.branches().select("branch_id", "year", "lat", "lon"), "branches")
    return rounded(spatial.nearest(d.places(), branches, by=["year"]))


CLOSED = """
    due AS (SELECT b.branch_id, b.year AS seen, b.lat, b.lon, y.year FROM d_branches b JOIN (SELECT DISTINCT year FROM d_branches) y
      ON y.year BETWEEN b.year + 1 AND b.year + 3),
    closed AS (SELECT * FROM due d WHERE NOT EXISTS (SELECT 1 FROM d_branches c WHERE c.branch_id = d.branch_id AND c.year = d.year)
      QUALIFY row_number() OVER (PARTITION BY branch_id, year ORDER BY seen DESC) = 1)"""


@query("j11_recent_closures", f"""
    WITH {CLOSED} SELECT p.tract_fips, y.year, coalesce(n, 0) AS closures_3y_within_10mi
    FROM d_places p CROSS JOIN (SELECT DISTINCT year FROM closed) y LEFT JOIN (
      SELECT p.tract_fips, b.year, count(*) AS n FROM d_places p JOIN closed b ON b.lat BETWEEN p.lat - 0.15 AND p.lat + 0.15 AND {HAVERSINE} <= 10 GROUP BY ALL) c
      ON c.tract_fips = p.tract_fips AND c.year = y.year""")
def _(d: Domain):
    closed = stored(spatial.recent_closures(d.branches()), "closures")
    return spatial.count_within(d.places(), closed, 10.0, by=["year"], output="closures_3y_within_10mi")


@query("j12_semi_join", "SELECT branch_id, year, bank_id FROM d_branches WHERE bank_id IN (SELECT s_suppkey % 5 FROM supplier WHERE s_nationkey = 3)")
def _(d: Domain):
    ids = d.table("supplier").where(F.col("s_nationkey") == 3).select((F.col("s_suppkey") % 5).alias("bank_id"))
    return d.branches().select("branch_id", "year", "bank_id").join(ids, "bank_id", "left_semi")


@query("j23_presence_flag", """
    SELECT p.tract_fips, p.year, CAST(EXISTS (SELECT 1 FROM d_branches b WHERE b.bank_id = 2 AND b.deposits > 150000 AND b.county_fips = p.county_fips AND b.year = p.year) AS INTEGER) AS active
    FROM d_panel p""")
def _(d: Domain):
    listed = d.branches().where((F.col("bank_id") == 2) & (F.col("deposits") > 150000))
    return spatial.presence_flag(d.panel().select("tract_fips", "county_fips", "year"), listed, ["county_fips", "year"], "active").drop("county_fips")


@query("branch_desert_label", f"""
    SELECT p.tract_fips, b.year, CAST(min({HAVERSINE}) > CASE WHEN is_rural = 1 THEN 15 ELSE 5 END AS INTEGER) AS is_branch_desert
    FROM d_places p CROSS JOIN d_branches b GROUP BY p.tract_fips, b.year, is_rural""")
def _(d: Domain):
    branches = stored(d.branches().select("branch_id", "year", "lat", "lon"), "branches")
    near = spatial.nearest(d.places(), branches, by=["year"])
    return near.join(d.places().select("tract_fips", "is_rural"), "tract_fips").select(
        "tract_fips", "year", cohorts.branch_desert("nearest_miles", "is_rural").alias("is_branch_desert"))


@query("j22_knn_peers", """
    WITH f AS (SELECT tract_fips, county_fips, n_lenders::DOUBLE AS a, n_loans::DOUBLE AS b, amount_k / 100000.0::DOUBLE AS c, n_small * 5.0::DOUBLE AS score FROM d_features),
    z AS (SELECT tract_fips, county_fips, score,
        (a - avg(a) OVER w) / CASE WHEN stddev_samp(a) OVER w = 0 THEN 1 ELSE stddev_samp(a) OVER w END AS za,
        (b - avg(b) OVER w) / CASE WHEN stddev_samp(b) OVER w = 0 THEN 1 ELSE stddev_samp(b) OVER w END AS zb,
        (c - avg(c) OVER w) / CASE WHEN stddev_samp(c) OVER w = 0 THEN 1 ELSE stddev_samp(c) OVER w END AS zc FROM f WINDOW w AS (PARTITION BY county_fips)),
    pool AS (SELECT *, count(*) OVER (PARTITION BY county_fips) AS n FROM z WHERE score >= 20)
    SELECT z.tract_fips, CAST(row_number() OVER (PARTITION BY z.tract_fips ORDER BY pow(z.za - p.za, 2) + pow(z.zb - p.zb, 2) + pow(z.zc - p.zc, 2), p.tract_fips) AS INTEGER) AS rank,
      round(pow(z.za - p.za, 2) + pow(z.zb - p.zb, 2) + pow(z.zc - p.zc, 2), 6) AS dist2
    FROM z JOIN pool p ON p.county_fips = z.county_fips AND p.tract_fips <> z.tract_fips AND p.n >= 5
    QUALIFY row_number() OVER (PARTITION BY z.tract_fips ORDER BY pow(z.za - p.za, 2) + pow(z.zb - p.zb, 2) + pow(z.zc - p.zc, 2), p.tract_fips) <= 3""")
def _(d: Domain):
    f = d.features().select("tract_fips", "county_fips", F.col("n_lenders").cast("double").alias("a"), F.col("n_loans").cast("double").alias("b"),
                            (F.col("amount_k") / 100000.0).alias("c"), (F.col("n_small") * 5.0).alias("score"))
    out = peers.knn_peers(stored(f, "features"), "tract_fips", "county_fips", ["a", "b", "c"], "score", k=3, pool_score=20.0, min_pool=5)
    return rounded(out.select("tract_fips", "rank", "dist2"))


# ---------------------------------------------------------------- merges of predictions

LATEST = """
    latest AS (SELECT tract_fips, county_fips, fold, year, y_prob, y_prob2 FROM d_scored QUALIFY row_number() OVER (PARTITION BY tract_fips ORDER BY year DESC) = 1)"""


@query("j17_outer_merge_models", f"""WITH {LATEST}
    SELECT coalesce(a.tract_fips, b.tract_fips) AS tract_fips, round(a.y_prob, 6) AS risk_m1, round(b.y_prob2, 6) AS risk_m2
    FROM (SELECT * FROM latest WHERE fold <> 'F1') a FULL JOIN (SELECT * FROM latest WHERE fold <> 'F2') b ON a.tract_fips = b.tract_fips""")
def _(d: Domain):
    latest = temporal.latest_per_key(d.scored(), ["tract_fips"], ["year"], ["fold", "y_prob", "y_prob2"])
    a = latest.where("fold <> 'F1'").select("tract_fips", F.col("y_prob").alias("risk_m1"))
    b = latest.where("fold <> 'F2'").select("tract_fips", F.col("y_prob2").alias("risk_m2"))
    return rounded(serving.merge_preferring_left(a, b, "tract_fips"))


@query("j18_merge_left_precedence", f"""WITH {LATEST}
    SELECT coalesce(a.tract_fips, b.tract_fips) AS tract_fips, a.n_lenders, a.year, b.households
    FROM (SELECT * FROM d_features WHERE is_rural = 1) a FULL JOIN
         (SELECT tract_fips, sum(households)::BIGINT AS households FROM d_demographics GROUP BY 1) b ON a.tract_fips = b.tract_fips""")
def _(d: Domain):
    left = d.features().where("is_rural = 1").select("tract_fips", "n_lenders", "year")
    right = d.demographics().groupBy("tract_fips").agg(F.sum("households").alias("households"), F.max("vintage").alias("year"))
    return serving.merge_preferring_left(left, right, "tract_fips")


@query("j19_prediction_join", """
    SELECT a.tract_fips, a.year, a.fold, round(a.y_prob, 6) AS base, round(b.y_prob2, 6) AS other, p.is_rural
    FROM d_scored a JOIN d_scored b ON a.tract_fips = b.tract_fips AND a.year = b.year AND a.fold = b.fold
    LEFT JOIN d_places p ON p.tract_fips = a.tract_fips""")
def _(d: Domain):
    s = d.scored()
    keys = ["tract_fips", "year", "fold"]
    a, b = s.select(*keys, F.col("y_prob").alias("base")), s.select(*keys, F.col("y_prob2").alias("other"))
    return rounded(a.join(b, keys).join(d.places().select("tract_fips", "is_rural"), "tract_fips", "left"))


@query("j21_renderable_only", """
    WITH l AS (SELECT o_orderkey, [o_orderkey % 2000, o_custkey, (o_orderkey * 7) % 2000] AS peers FROM orders),
    e AS (SELECT o_orderkey, unnest(peers) AS item, generate_subscripts(peers, 1) AS pos FROM l)
    SELECT o_orderkey, array_to_string(list(item ORDER BY pos), ',') AS peers FROM e WHERE item IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def _(d: Domain):
    k = F.col("o_orderkey")
    lists = d.table("orders").select("o_orderkey", F.array(k % 2000, F.col("o_custkey"), k * 7 % 2000).alias("peers"))
    known = d.table("customer").where("c_acctbal > 0").select("c_custkey")
    out = serving.renderable_only(lists, "o_orderkey", "peers", known, "c_custkey")
    return out.select("o_orderkey", F.array_join("peers", ",").alias("peers"))


# ---------------------------------------------------------------- entity matching

DROPPED = "'national','association','the','a','of','and','co','company','corp','corporation','inc','incorporated','fsb','ssb','na','natl','trust','tr','tc','bank','banking','bk','savings','savg','sav','federal','fed','fdl'"
NORMAL = f"array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(name), '[^\\w\\s]', ' ', 'g')), '\\s+'), lambda t: t <> '' AND t NOT IN ({DROPPED})), ' ')"
SCORED = """
    tok AS (SELECT *, list_sort(list_intersect(ta, tb)) AS s,
              list_sort(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS ra, list_sort(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS rb FROM pairs),
    str AS (SELECT *, array_to_string(s, ' ') AS t0, array_to_string(list_concat(s, ra), ' ') AS t1, array_to_string(list_concat(s, rb), ' ') AS t2 FROM tok),
    scored AS (SELECT *, greatest(100.0::DOUBLE * (1 - levenshtein(t1, t2) / greatest(length(t1), length(t2))),
        CASE WHEN t0 <> '' THEN 100.0::DOUBLE * (1 - levenshtein(t0, t1) / length(t1)) ELSE 0 END,
        CASE WHEN t0 <> '' THEN 100.0::DOUBLE * (1 - levenshtein(t0, t2) / length(t2)) ELSE 0 END) AS score FROM str)"""
NAMED = f"""
    r AS (SELECT *, {NORMAL} AS nn FROM d_reporters), i AS (SELECT *, {NORMAL} AS nn FROM d_institutions),
    rt AS (SELECT *, list_sort(list_distinct(string_split(nn, ' '))) AS toks FROM r),
    it AS (SELECT *, list_sort(list_distinct(string_split(nn, ' '))) AS toks FROM i)"""


@query("f02_normalize_name", f"WITH {NAMED} SELECT institution_id, nn AS name_norm FROM i")
def _(d: Domain):
    return d.institutions().select("institution_id", normalize_name("name").alias("name_norm"))


@query("f03_fuzzy_pairs", f"""WITH {NAMED},
    pairs AS (SELECT DISTINCT r.state, r.nn AS name_norm, i.nn AS other, r.toks AS ta, i.toks AS tb FROM rt r JOIN it i ON r.state = i.state), {SCORED}
    SELECT state, name_norm, other, round(score, 6) AS score FROM scored WHERE score >= 75 - 1e-9""")
def _(d: Domain):
    left = d.reporters().withColumn("name_norm", normalize_name("name"))
    right = d.institutions().withColumn("name_norm", normalize_name("name"))
    return rounded(matching.scored_pairs(left, right, ["state"], "name_norm", 75.0))


MATCHED = f"""{NAMED},
    pairs AS (SELECT r.reporter_id, r.state, r.city, r.nn AS a, i.institution_id, i.city AS icity, i.nn AS b, r.toks AS ta, i.toks AS tb
              FROM rt r JOIN it i ON r.state = i.state), {SCORED},
    p1 AS (SELECT reporter_id, min(institution_id) AS institution_id FROM scored WHERE a = b GROUP BY 1),
    p2 AS (SELECT reporter_id, institution_id, score FROM scored WHERE score >= 90 - 1e-9 AND reporter_id NOT IN (SELECT reporter_id FROM p1)
           QUALIFY row_number() OVER (PARTITION BY reporter_id ORDER BY score DESC, institution_id) = 1),
    p3 AS (SELECT reporter_id, institution_id, score FROM scored WHERE score >= 75 - 1e-9 AND city = icity AND reporter_id NOT IN (SELECT reporter_id FROM p1)
             AND reporter_id NOT IN (SELECT reporter_id FROM p2)
           QUALIFY row_number() OVER (PARTITION BY reporter_id ORDER BY score DESC, institution_id) = 1),
    matched AS (SELECT reporter_id, institution_id, 'exact' AS match_method, 100.0::DOUBLE AS score, 1.0::DOUBLE AS confidence FROM p1
      UNION ALL SELECT reporter_id, institution_id, 'fuzzy_state', score, 0.9 FROM p2
      UNION ALL SELECT reporter_id, institution_id, CASE WHEN score >= 85 THEN 'city_fuzzy' ELSE 'review' END, score, CASE WHEN score >= 85 THEN 0.85 ELSE 0.6 END FROM p3)"""


def _matches(d: Domain):
    left = d.reporters().withColumn("name_norm", normalize_name("name"))
    right = d.institutions().withColumn("name_norm", normalize_name("name"))
    return matching.match_entities(left, right, "reporter_id", "institution_id")


@query("j15_entity_matching", f"WITH {MATCHED} SELECT reporter_id, institution_id, match_method, round(score, 6) AS score, confidence FROM matched")
def _(d: Domain):
    return rounded(_matches(d))


@query("a33_volume_match_rate", f"""WITH {MATCHED}
    SELECT round(sum(amount), 2) AS total_amount, round(sum(amount) FILTER (m.reporter_id IS NOT NULL), 2) AS matched_amount,
      round(sum(amount) FILTER (m.reporter_id IS NOT NULL) / sum(amount), 6) AS match_rate
    FROM d_reporters r LEFT JOIN (SELECT DISTINCT reporter_id FROM matched WHERE match_method <> 'review') m ON m.reporter_id = r.reporter_id""")
def _(d: Domain):
    sure = _matches(d).where("match_method <> 'review'")
    best = matching.best_match(sure, "reporter_id", "institution_id")
    return rounded(matching.volume_match_rate(d.reporters(), best, "reporter_id", "amount"), 6, total_amount=2, matched_amount=2)
