"""Queries: cleaning predicates, concentration, roll-ups, cohorts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import geo as G
from ..functions import guards as U
from ..functions import risk as R
from ..operators import cohorts, concentration, evaluation, orderstats, rollups, serving, temporal
from ..plans.domain import Domain
from ..session import stored
from .registry import query, rounded

# ---------------------------------------------------------------- projections and predicates


@query("p01_composite_keys", """
    SELECT l_suppkey, l_orderkey, l_linenumber,
           trim(' ' || (l_suppkey % 5)) || '_' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS lender_id,
           lpad(CAST(l_suppkey % 56 AS VARCHAR), 2, '0') || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS county_fips,
           lpad(CAST(l_suppkey % 56 AS VARCHAR), 2, '0') || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0')
             || lpad(CAST(l_orderkey % 1000000 AS VARCHAR), 6, '0') AS tract_fips,
           lpad(CAST(l_suppkey % 56 AS VARCHAR), 2, '0') AS state_fips
    FROM lineitem""")
def _(d: Domain):
    s = C.pad_left((F.col("l_suppkey") % 56).cast("string"), 2)
    c = C.pad_left((F.col("l_partkey") % 1000).cast("string"), 3)
    t = C.pad_left((F.col("l_orderkey") % 1000000).cast("string"), 6)
    return d.table("lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber",
        C.lender_key(F.concat(F.lit(" "), F.col("l_suppkey") % 5), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("lender_id"),
        C.county_key(s, c).alias("county_fips"), C.tract_key(s, c, t).alias("tract_fips"),
        C.state_of(C.tract_key(s, c, t)).alias("state_fips"),
    )


@query("p02_normalize_tract", """
    WITH raw AS (
      SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN (p_partkey % 10000) || '.' || lpad(CAST(p_size AS VARCHAR), 2, '0')
               WHEN 1 THEN ' na ' WHEN 2 THEN '' WHEN 3 THEN (1000000 + p_partkey)::VARCHAR
               WHEN 4 THEN ' ' || (p_partkey % 1000) || ' ' ELSE 'T' || p_size END AS raw FROM part),
    bare AS (SELECT p_partkey, replace(replace(trim(raw), '.', ''), ' ', '') AS t FROM raw)
    SELECT p_partkey, CASE WHEN t = '' OR upper(t) = 'NA' THEN NULL
             WHEN regexp_full_match(repeat('0', greatest(0, 6 - length(t))::INT) || t, '[0-9]{6}')
             THEN repeat('0', greatest(0, 6 - length(t))::INT) || t END AS tract FROM bare""")
def _(d: Domain):
    k, s = F.col("p_partkey"), F.col("p_size")
    raw = (
        F.when(s % 6 == 0, F.concat(k % 10000, F.lit("."), F.lpad(s.cast("string"), 2, "0"))).when(s % 6 == 1, " na ")
        .when(s % 6 == 2, "").when(s % 6 == 3, (k + 1000000).cast("string"))
        .when(s % 6 == 4, F.concat(F.lit(" "), k % 1000, F.lit(" "))).otherwise(F.concat(F.lit("T"), s))
    )
    return d.table("part").select("p_partkey", C.normalize_tract(raw).alias("tract"))


@query("p03_permissive_casts", """
    WITH raw AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' ' || p_partkey WHEN 1 THEN '-' || p_size
                        WHEN 2 THEN p_retailprice::VARCHAR WHEN 3 THEN '' ELSE p_name END AS raw FROM part)
    SELECT p_partkey, CASE WHEN regexp_full_match(trim(raw), '-?[0-9]+') THEN CAST(trim(raw) AS BIGINT) ELSE 0 END AS as_int,
           coalesce(try_cast(trim(raw) AS DOUBLE), 0.0) AS as_float FROM raw""")
def _(d: Domain):
    k, s = F.col("p_partkey"), F.col("p_size")
    raw = (
        F.when(s % 5 == 0, F.concat(F.lit(" "), k)).when(s % 5 == 1, F.concat(F.lit("-"), s))
        .when(s % 5 == 2, F.col("p_retailprice").cast("string")).when(s % 5 == 3, "").otherwise(F.col("p_name"))
    )
    return d.table("part").select("p_partkey", C.to_int(raw).alias("as_int"), C.to_float(raw).alias("as_float"))


@query("p04_sentinel_to_null", """
    WITH raw AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-666666666' ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer)
    SELECT c_custkey, CASE WHEN raw LIKE '-66666%' THEN NULL ELSE CAST(raw AS DOUBLE) END AS estimate FROM raw""")
def _(d: Domain):
    raw = F.when(F.col("c_acctbal") < 0, "-666666666").otherwise(F.col("c_custkey").cast("string"))
    return d.table("customer").select("c_custkey", C.census_number(raw).alias("estimate"))


@query("p05_year_of_date", """
    WITH raw AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
                        WHEN 'O' THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'n/a' END AS raw FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN raw LIKE '%-%' THEN split_part(raw, '-', 1)
                                 WHEN raw LIKE '%/%/____' THEN split_part(raw, '/', 3) END AS INTEGER) AS year FROM raw""")
def _(d: Domain):
    s, t = F.col("o_orderstatus"), F.col("o_orderdate")
    raw = F.when(s == "F", F.date_format(t, "yyyy-MM-dd")).when(s == "O", F.date_format(t, "MM/dd/yyyy")).otherwise("n/a")
    return d.table("orders").select("o_orderkey", C.year_of_date(raw).alias("year"))


@query("p06_money", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS amount FROM orders""")
def _(d: Domain):
    whole = F.floor("o_totalprice").cast("long")
    text = F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(F.concat(F.lit(" $"), F.format_number(whole, 0)))
    return d.table("orders").select("o_orderkey", C.money(text).alias("amount"))


@query("p07_coordinate_bounds", """
    WITH p AS (SELECT tract_fips, lat + (tract_fips % 60) - 15 AS lat, lon - (tract_fips % 100) + 30 AS lon FROM d_places)
    SELECT tract_fips, lat BETWEEN 17 AND 72 AND lon BETWEEN -180 AND -65 AS covered,
           lat > 14 AND lat < 72 AND lon > -180 AND lon < -50 AS drawable FROM p""")
def _(d: Domain):
    t = F.col("tract_fips")
    moved = d.places().select("tract_fips", (F.col("lat") + t % 60 - 15).alias("lat"), (F.col("lon") - t % 100 + 30).alias("lon"))
    return moved.select("tract_fips", G.in_coverage("lat", "lon").alias("covered"), G.in_map_view("lat", "lon").alias("drawable"))


@query("p08_territories_excluded", """
    SELECT c_custkey, lpad(CAST(c_custkey % 80 AS VARCHAR), 2, '0') AS state_fips FROM customer
    WHERE lpad(CAST(c_custkey % 80 AS VARCHAR), 2, '0') NOT IN ('72', '78', '60', '66', '69')""")
def _(d: Domain):
    state = F.lpad((F.col("c_custkey") % 80).cast("string"), 2, "0")
    # Territory codes.
    return d.table("customer").select("c_custkey", state.alias("state_fips")).where(
        ~F.col("state_fips").isin("72", "78", "60", "66", "69")
    )


@query("p09_support_gate", """
    SELECT tract_fips, year, n_lenders, CASE WHEN n_lenders >= 3 THEN round(amount_k / n_loans, 6) END AS mean_loan FROM d_panel""")
def _(d: Domain):
    return rounded(d.panel().select("tract_fips", "year", "n_lenders", U.gated(F.col("amount_k") / F.col("n_loans"), "n_lenders").alias("mean_loan")))


@query("p10_zero_fill", """
    SELECT tract_fips, year, coalesce(population, 0) AS population, CAST(year >= 1998 AS INTEGER) AS has_applications FROM d_panel""")
def _(d: Domain):
    filled = U.zero_filled(d.panel().select("tract_fips", "year", "population"), ["population", "not_there"])
    return filled.withColumn("has_applications", (F.col("year") >= 1998).cast("int"))


@query("p11_effective_date_mask", """
    SELECT tract_fips, year, CASE WHEN year < 1998 THEN 0 WHEN population IS NULL THEN 0 ELSE is_rural END AS in_zone FROM d_panel""")
def _(d: Domain):
    zone = F.when(F.col("population").isNotNull(), F.col("is_rural"))
    return d.panel().select("tract_fips", "year", U.effective_from(zone, "year", 1998).alias("in_zone"))


@query("p12_rural_band", """
    SELECT c_custkey, CAST(CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey % 10 + 1 >= 7 AS INTEGER) ELSE 0 END AS INTEGER) AS is_rural FROM customer""")
def _(d: Domain):
    code = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") % 10 + 1)
    return d.table("customer").select("c_custkey", U.rural_band(code).alias("is_rural"))


@query("p15_demographic_percentages", """
    WITH u AS (SELECT tract_fips, year, CAST(n_loans - 1 AS DOUBLE) AS universe, CAST(n_small AS DOUBLE) AS part,
                      CAST(n_lenders AS DOUBLE) AS other, CASE WHEN population IS NULL THEN NULL ELSE 1.0::DOUBLE END AS degrees FROM d_panel)
    SELECT tract_fips, year,
      CASE WHEN universe > 0 THEN round(part * 100.0::DOUBLE / universe, 2) END AS pct_poverty,
      CASE WHEN universe > 0 THEN round((1.0::DOUBLE - part / universe) * 100.0::DOUBLE, 2) + 0.0 END AS pct_minority,
      CASE WHEN universe > 0 THEN round(other * 100.0::DOUBLE / universe, 2) END AS unemployment_rate,
      CASE WHEN universe > 0 AND part + coalesce(degrees, 0) > 0
           THEN round((part + coalesce(degrees, 0)) * 100.0::DOUBLE / universe, 2) END AS pct_bachelor_plus
    FROM u""")
def _(d: Domain):
    universe = (F.col("n_loans") - 1).cast("double")
    part, other = F.col("n_small").cast("double"), F.col("n_lenders").cast("double")
    zero = F.lit(0.0)
    raw = d.panel().select(
        "tract_fips", "year", part.alias("below_poverty"), universe.alias("poverty_universe"), universe.alias("race_universe"),
        part.alias("n_white"), other.alias("n_black"), other.alias("n_hispanic"), other.alias("n_vacant"),
        universe.alias("housing_units"), other.alias("n_unemployed"), universe.alias("labor_force"),
        part.alias("n_bachelors"), F.when(F.col("population").isNotNull(), F.lit(1.0)).alias("n_masters"),
        zero.alias("n_professional"), zero.alias("n_doctorate"), universe.alias("edu_universe"),
    )
    out = rollups.demographic_shares(raw)
    return rounded(out.select("tract_fips", "year", "pct_poverty", "pct_minority", "unemployment_rate", "pct_bachelor_plus"))


@query("p17_selection", """
    SELECT tract_fips, model, risk FROM d_risks
    WHERE state_fips = 1 AND is_rural = 1 AND (population IS NULL OR population >= 1000) AND risk * 100 >= 20""")
def _(d: Domain):
    chosen = R.Selection(state=1, rural_only=True, ranges={"population": (1000.0, 10000.0, 10000.0)}, min_risk_pct=20.0)
    return d.risks().where(chosen.predicate("state_fips", "is_rural", "is_rural", "risk")).select("tract_fips", "model", "risk")


@query("p18_model_divergence", """
    SELECT tract_fips, year, CASE WHEN NOT (abs(a - b) >= 0.03 OR (a > 0 AND b >= a * 3) OR (b > 0 AND a >= b * 3)) THEN NULL
        WHEN a >= 0.05 AND b < 0.02 THEN 'first_higher' WHEN a < 0.02 AND b >= 0.05 THEN 'second_higher'
        WHEN a >= 0.05 AND b >= 0.05 THEN 'both_elevated' WHEN a < 0.02 AND b < 0.02 THEN 'both_low' ELSE 'mixed' END AS label
    FROM (SELECT tract_fips, year, y_prob * 0.1::DOUBLE AS a, y_prob2 * 0.1::DOUBLE AS b FROM d_scored)""")
def _(d: Domain):
    return d.scored().select("tract_fips", "year", R.divergence_label(F.col("y_prob") * 0.1, F.col("y_prob2") * 0.1).alias("label"))


@query("p19_direction_class", """
    WITH r AS (SELECT tract_fips, model, feature,
                 (rank() OVER w + (count(*) OVER (PARTITION BY model, feature, attribution) - 1) / 2.0::DOUBLE)
                   / count(*) OVER (PARTITION BY model, feature) * 100.0 AS pct
               FROM d_drivers WINDOW w AS (PARTITION BY model, feature ORDER BY attribution))
    SELECT tract_fips, model, feature, CASE
       WHEN (feature IN ('lender_hhi_tract_resid', 'pct_poverty') AND pct > 50) OR (feature IN ('branches_within_5mi', 'population') AND pct < 50) THEN 'bad'
       WHEN pct = 50 THEN 'neutral' ELSE 'good' END AS colour FROM r""")
def _(d: Domain):
    ranked = orderstats.percentile_rank(d.drivers(), ["model", "feature"], "attribution", "pct")
    return ranked.select("tract_fips", "model", "feature", R.direction_class(R.direction_of("feature"), "pct").alias("colour"))


@query("p21_three_valued_flag", """
    SELECT c_custkey, CASE WHEN population IS NULL THEN NULL ELSE CAST(population < 5000 AS INTEGER) END AS is_small,
           CAST(c_nationkey = 4 AS INTEGER) AS is_cu
    FROM d_places JOIN customer ON c_custkey = tract_fips""")
def _(d: Domain):
    return d.places().select(
        F.col("tract_fips").alias("c_custkey"), U.below_threshold("population", 5000.0).alias("is_small"),
        U.flag(F.col("county_fips") == 4).alias("is_cu"),
    )


# ---------------------------------------------------------------- aggregations


@query("a01_bucket_totals", """
    SELECT county_fips, lender_id, year, CAST(sum(count_lt_100) AS BIGINT) AS count_lt_100, round(sum(amount_lt_100), 2) AS amount_lt_100,
      CAST(sum(count_100_250) AS BIGINT) AS count_100_250, round(sum(amount_100_250), 2) AS amount_100_250,
      CAST(sum(count_250_1m) AS BIGINT) AS count_250_1m, round(sum(amount_250_1m), 2) AS amount_250_1m
    FROM d_fact GROUP BY ALL""")
def _(d: Domain):
    return rounded(rollups.bucket_totals(d.fact(), ["county_fips", "lender_id", "year"]), 2)


@query("a02_distinct_lenders", "SELECT tract_fips, year, count(DISTINCT lender_id) AS n_lenders FROM d_fact GROUP BY ALL")
def _(d: Domain):
    return d.fact().groupBy("tract_fips", "year").agg(F.count_distinct("lender_id").alias("n_lenders"))


@query("a03_place_totals", """
    SELECT tract_fips, year, CAST(sum(n_loans) AS DOUBLE) AS total_loans, CAST(sum(count_lt_100) AS DOUBLE) AS n_under_100,
      CAST(sum(count_100_250) AS DOUBLE) AS n_100_250, count(DISTINCT lender_id) AS n_active_lenders FROM d_fact GROUP BY ALL""")
def _(d: Domain):
    return concentration.place_totals(d.fact(), ["tract_fips", "year"])


@query("a04_hhi", """
    SELECT tract_fips, year, round(sum(share * share), 6) AS hhi FROM (
      SELECT tract_fips, year, n_loans / sum(n_loans) OVER (PARTITION BY tract_fips, year) AS share FROM d_fact) GROUP BY ALL""")
def _(d: Domain):
    return rounded(d.fact().groupBy("tract_fips", "year").agg(concentration.herfindahl(F.col("n_loans").cast("double")).alias("hhi")))


@query("a05_top_shares", """
    SELECT tract_fips, year, round(sum(n_loans) FILTER (rn <= 1) / sum(n_loans), 6) AS top1_share,
           round(sum(n_loans) FILTER (rn <= 3) / sum(n_loans), 6) AS top3_share
    FROM (SELECT *, row_number() OVER (PARTITION BY tract_fips, year ORDER BY n_loans DESC, lender_id) AS rn FROM d_fact) GROUP BY ALL""")
def _(d: Domain):
    return rounded(concentration.top_shares(d.fact(), ["tract_fips", "year"], "n_loans", "lender_id"))


@query("a06_small_loan_shares", """
    SELECT tract_fips, year, round(sum(count_lt_100) / sum(n_loans), 6) AS pct_under_100k,
           round(sum(count_lt_100 + count_100_250) / sum(n_loans), 6) AS pct_under_250k FROM d_fact GROUP BY ALL""")
def _(d: Domain):
    t = concentration.place_totals(d.fact(), ["tract_fips", "year"])
    return rounded(t.select("tract_fips", "year", U.ratio("n_under_100", "total_loans").alias("pct_under_100k"),
                            U.ratio(F.col("n_under_100") + F.col("n_100_250"), "total_loans").alias("pct_under_250k")))


def _lender_flags(d: Domain):
    s = d.table("supplier")
    totals = stored(d.lender_totals(), "lender-totals")
    grid = totals.select("lender_id", "year")
    assets = grid.join(s, F.col("lender_id") == F.col("s_suppkey")).select(
        "lender_id", "year", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") + F.col("year")).alias("assets"))
    cu = s.where(F.col("s_nationkey") == 4).select(F.col("s_suppkey").alias("lender_id"))
    mission = s.where(F.col("s_nationkey") > 20).select(F.col("s_suppkey").alias("lender_id"))
    national = totals.select("lender_id", "year", F.round("amount_k", 2).alias("amount"))
    return concentration.lender_flags(grid, assets, national, {"is_credit_union": cu, "is_mission": mission}, 6000.0)


LENDER_FLAGS = """
    national AS (SELECT year, lender_id, round(sum(amount_k), 2) AS amount FROM d_fact GROUP BY ALL),
    top4 AS (SELECT * FROM national QUALIFY row_number() OVER (PARTITION BY year ORDER BY amount DESC, lender_id) <= 4),
    flags AS (SELECT n.lender_id, n.year, CASE WHEN s_acctbal > 0 THEN s_acctbal + n.year END AS assets,
        CAST(CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal + n.year < 6000 AS INTEGER) END AS INTEGER) AS is_community_bank,
        CAST(t.lender_id IS NOT NULL AS INTEGER) AS is_top4, CAST(s_nationkey = 4 AS INTEGER) AS is_credit_union,
        CAST(s_nationkey > 20 AS INTEGER) AS is_mission
      FROM national n JOIN supplier ON s_suppkey = n.lender_id LEFT JOIN top4 t ON t.lender_id = n.lender_id AND t.year = n.year)"""


@query("o01_top4_lenders", f"WITH {LENDER_FLAGS} SELECT lender_id, year FROM flags WHERE is_top4 = 1")
def _(d: Domain):
    national = d.fact().groupBy("lender_id", "year").agg(F.round(F.sum("amount_k"), 2).alias("amount"))
    return concentration.top_k_rows(national, ["year"], "amount", "lender_id", 4).select("lender_id", "year")


@query("j16_lender_flags", f"WITH {LENDER_FLAGS} SELECT lender_id, year, round(assets, 6) AS assets, is_community_bank, is_top4, is_credit_union, is_mission FROM flags")
def _(d: Domain):
    return rounded(_lender_flags(d))


@query("a07_lender_mix", f"""WITH {LENDER_FLAGS}
    SELECT f.tract_fips, f.year, count(DISTINCT f.lender_id) AS n_active_lenders,
      CASE WHEN count(DISTINCT f.lender_id) >= 3 THEN round(sum(n_loans * coalesce(is_community_bank, 0)) / sum(n_loans), 6) END AS pct_community,
      CASE WHEN count(DISTINCT f.lender_id) >= 3 THEN round(sum(n_loans * is_top4) / sum(n_loans), 6) END AS pct_top4,
      CASE WHEN count(DISTINCT f.lender_id) >= 3 THEN round(sum(n_loans * is_credit_union) / sum(n_loans), 6) END AS pct_credit_union
    FROM d_fact f JOIN flags g ON f.lender_id = g.lender_id AND f.year = g.year GROUP BY ALL""")
def _(d: Domain):
    shares = {"is_community_bank": "pct_community", "is_top4": "pct_top4", "is_credit_union": "pct_credit_union"}
    return rounded(concentration.lender_mix(d.fact(), _lender_flags(d), shares))


@query("a08_county_lending", """
    WITH l AS (SELECT county_fips, year, lender_id, CAST(sum(n_loans) AS DOUBLE) AS c, sum(amount_k) AS a FROM d_fact GROUP BY ALL)
    SELECT county_fips, year, count(*) AS n_lenders, sum(c) AS total_count, round(sum(a), 2) AS total_amount,
      round(sum(c * c) / (sum(c) * sum(c)), 6) AS count_hhi, round(sum(a * a) / (sum(a) * sum(a)), 6) AS amount_hhi,
      round(max(c) / sum(c), 6) AS top_share_count, round(max(a) / sum(a), 6) AS top_share_amount FROM l GROUP BY ALL""")
def _(d: Domain):
    m = concentration.market_structure(d.fact(), ["county_fips", "year"], "lender_id", {"n_loans": "c", "amount_k": "a"})
    return rounded(m.select(
        "county_fips", "year", F.col("n_entities").alias("n_lenders"), F.col("c_total").alias("total_count"),
        F.col("a_total").alias("total_amount"), F.col("c_hhi").alias("count_hhi"), F.col("a_hhi").alias("amount_hhi"),
        F.col("c_top_share").alias("top_share_count"), F.col("a_top_share").alias("top_share_amount")), total_amount=2)


BRANCH_MARKET = """
    market AS (SELECT county_fips, year, CAST(sum(b) AS BIGINT) AS branch_count, count(*) AS bank_count, round(round(sum(dep), 2), 0) AS total_deposits,
        round(sum(dep), 2) / CAST(sum(b) AS BIGINT) AS avg_deposits, round(sum(dep * dep) / (sum(dep) * sum(dep)), 6) AS deposit_hhi,
        round(max(dep) / sum(dep), 6) AS top_bank_share
      FROM (SELECT county_fips, year, bank_id, count(*) AS b, sum(deposits) AS dep FROM d_branches GROUP BY ALL) GROUP BY ALL)"""


@query("a09_branch_market", f"WITH {BRANCH_MARKET} SELECT * FROM market")
def _(d: Domain):
    return rollups.branch_market(d.branches(), average_digits=None)


@query("j14_calendar_change", f"""WITH {BRANCH_MARKET}
    SELECT c.* EXCLUDE (avg_deposits), c.branch_count - p.branch_count AS branch_count_chg1yr, c.branch_count - q.branch_count AS branch_count_chg3yr,
      round(c.deposit_hhi - p.deposit_hhi, 4) + 0.0 AS deposit_hhi_chg1yr, round(c.deposit_hhi - q.deposit_hhi, 4) + 0.0 AS deposit_hhi_chg3yr,
      round((c.total_deposits - p.total_deposits) / p.total_deposits * 100.0::DOUBLE, 4) AS total_deposits_pctchg1yr,
      round((c.total_deposits - q.total_deposits) / q.total_deposits * 100.0::DOUBLE, 4) AS total_deposits_pctchg3yr
    FROM market c LEFT JOIN market p ON p.county_fips = c.county_fips AND p.year = c.year - 1
                  LEFT JOIN market q ON q.county_fips = c.county_fips AND q.year = c.year - 3""")
def _(d: Domain):
    m = rollups.branch_market(d.branches(), average_digits=None)
    out = temporal.calendar_change(m, "county_fips", "year", ["branch_count", "deposit_hhi", "total_deposits"], (1, 3), ("total_deposits",))
    return rounded(out.drop("avg_deposits", "total_deposits_chg1yr", "total_deposits_chg3yr"), deposit_hhi_chg1yr=4, deposit_hhi_chg3yr=4,
                   total_deposits_pctchg1yr=4, total_deposits_pctchg3yr=4)


@query("a10_loan_rollup", """
    SELECT state_fips, zip, year, count(*) AS n_loans, count(*) FILTER (program = '7a') AS n_7a, count(*) FILTER (program = '504') AS n_504,
      round(sum(gross), 2) AS sum_gross, round(sum(guaranteed), 5) AS sum_guaranteed,
      count(DISTINCT nullif(trim(lender), '')) AS n_distinct_lenders FROM d_loans GROUP BY ALL""")
def _(d: Domain):
    return rounded(rollups.loan_rollup(d.loans(), ["state_fips", "zip", "year"], ["7a", "504"]), 2, sum_guaranteed=5)


@query("a11_application_rollup", """
    SELECT tract_fips, year(ts)::INTEGER AS year, count(*) AS n_applications, count(*) FILTER (action = 1) AS n_originated,
      count(*) FILTER (action = 3) AS n_denied, count(*) FILTER (action = 4) AS n_withdrawn, count(*) FILTER (action = 6) AS n_purchased,
      round(coalesce(count(*) FILTER (action = 1) / nullif(count(*) FILTER (action IN (1, 3, 4)), 0), 0), 4) AS approval_rate,
      round(coalesce(count(*) FILTER (action = 3) / nullif(count(*) FILTER (action IN (1, 3, 4)), 0), 0), 4) AS denial_rate,
      round(coalesce(sum(amount) FILTER (amount > 0), 0), 2) AS sum_amount,
      round(coalesce(avg(amount) FILTER (amount > 0), 0), 4) AS mean_amount,
      count(DISTINCT nullif(lender, '')) AS n_distinct_lenders, count(*) FILTER (race = 'White') AS n_white,
      count(*) FILTER (race = 'Black or African American') AS n_black, count(*) FILTER (race = 'Asian') AS n_asian,
      count(*) FILTER (ethnicity = 'Hispanic or Latino') AS n_hispanic, count(*) FILTER (race = 'Other') AS n_other_race
    FROM d_applications WHERE action IS NOT NULL GROUP BY 1, 2""")
def _(d: Domain):
    a = d.applications().withColumn("year", F.year("ts"))
    return rounded(rollups.application_rollup(a, ["tract_fips", "year"]), 4, sum_amount=2)


@query("a12_always_present", """
    SELECT tract_fips, count(DISTINCT year) AS n_years FROM d_fact GROUP BY 1
    HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM d_fact)""")
def _(d: Domain):
    return concentration.always_present(d.fact(), "tract_fips", "year")


@query("a13_entity_churn", """
    WITH s AS (SELECT tract_fips, year, list(DISTINCT lender_id) AS l FROM d_fact GROUP BY ALL),
    j AS (SELECT c.tract_fips, c.year, c.l, coalesce(p.l, []) AS p, coalesce(q.l, []) AS q FROM s c
          LEFT JOIN s p ON p.tract_fips = c.tract_fips AND p.year = c.year - 1
          LEFT JOIN s q ON q.tract_fips = c.tract_fips AND q.year = c.year - 3)
    SELECT tract_fips, year, len(l) AS n_lenders, len(l) - len(list_intersect(l, p)) AS entries_1yr, len(p) - len(list_intersect(l, p)) AS exits_1yr,
      len(l) + len(p) - 2 * len(list_intersect(l, p)) AS churn_1yr,
      CASE WHEN len(p) > 0 THEN round(len(list_intersect(l, p)) / len(p), 4) END AS retention_1yr,
      len(l) - len(list_intersect(l, q)) AS entries_3yr, len(q) - len(list_intersect(l, q)) AS exits_3yr,
      len(l) + len(q) - 2 * len(list_intersect(l, q)) AS churn_3yr,
      CASE WHEN len(q) > 0 THEN round(len(list_intersect(l, q)) / len(q), 4) END AS retention_3yr FROM j""")
def _(d: Domain):
    return rounded(concentration.entity_churn(d.fact()), 4)


@query("a15_residualize", """
    WITH w AS (SELECT *, ln(1 + n_lenders::DOUBLE) AS x1, n_lenders::DOUBLE AS x2,
                 CASE WHEN n_lenders >= 3 THEN amount_k / n_loans / 1000.0::DOUBLE END AS y1, n_small / n_loans::DOUBLE AS y2 FROM d_panel),
    m AS (SELECT year, is_rural, count(y1) AS n1, count(y2) AS n2,
        avg(x1) FILTER (y1 IS NOT NULL) AS a1, avg(x2) FILTER (y1 IS NOT NULL) AS a2, avg(y1) AS ay,
        var_pop(x1) FILTER (y1 IS NOT NULL) AS s11, var_pop(x2) FILTER (y1 IS NOT NULL) AS s22,
        covar_pop(x1, x2) FILTER (y1 IS NOT NULL) AS s12, covar_pop(x1, y1) AS s1y, covar_pop(x2, y1) AS s2y,
        avg(x1) AS b1, avg(x2) AS b2, avg(y2) AS bby, var_pop(x1) AS t11, var_pop(x2) AS t22, covar_pop(x1, x2) AS t12,
        covar_pop(x1, y2) AS t1y, covar_pop(x2, y2) AS t2y FROM w GROUP BY ALL)
    SELECT tract_fips, w.year, CASE WHEN n1 >= 50 THEN round(y1 - ay - (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) * (x1 - a1)
              - (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) * (x2 - a2), 6) + 0.0 END AS y1_resid,
      CASE WHEN n2 >= 50 THEN round(y2 - bby - (t22 * t1y - t12 * t2y) / (t11 * t22 - t12 * t12) * (x1 - b1)
              - (t11 * t2y - t12 * t1y) / (t11 * t22 - t12 * t12) * (x2 - b2), 6) + 0.0 END AS y2_resid
    FROM w JOIN m ON w.year = m.year AND w.is_rural = m.is_rural""")
def _(d: Domain):
    p = d.panel().select(
        "tract_fips", "year", "is_rural", "n_lenders",
        U.gated(F.col("amount_k") / F.col("n_loans") / 1000.0, "n_lenders").alias("y1"),
        (F.col("n_small") / F.col("n_loans").cast("double")).alias("y2"))
    out = cohorts.residualize(p, ["year", "is_rural"], ["y1", "y2"], "n_lenders")
    return rounded(out.select("tract_fips", "year", "y1_resid", "y2_resid"))


@query("a16_cohort_quantiles", """
    SELECT year, is_rural, round(quantile_cont(n_lenders::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(n_lenders::DOUBLE, 0.5), 6) AS median,
      round(quantile_cont(n_lenders::DOUBLE, 0.95), 6) AS p95 FROM d_panel GROUP BY ALL""")
def _(d: Domain):
    return rounded(orderstats.quantile_columns(d.panel(), ["year", "is_rural"], "n_lenders", {"p10": 0.1, "median": 0.5, "p95": 0.95}))


DESERTS = """
    cuts AS (SELECT year, is_rural, quantile_cont(n_lenders::DOUBLE, 0.1) AS t, quantile_cont(n_lenders::DOUBLE, 0.5) AS m FROM d_panel GROUP BY ALL),
    rated AS (SELECT *, CASE WHEN year >= 1998 AND population > 0 THEN n_loans * 1000.0::DOUBLE / population END AS per1k FROM d_panel),
    ocuts AS (SELECT year, is_rural, quantile_cont(per1k, 0.1) AS t FROM rated WHERE per1k IS NOT NULL GROUP BY ALL),
    labelled AS (SELECT r.tract_fips, r.year, r.is_rural, CAST(r.n_lenders <= c.t AS INTEGER) AS is_service_desert, c.m - r.n_lenders AS service_desert_score,
        r.per1k, CAST(r.per1k <= o.t AS INTEGER) AS is_origination_desert,
        CAST(r.n_lenders <= c.t OR coalesce(r.per1k <= o.t, false) AS INTEGER) AS is_any_desert
      FROM rated r JOIN cuts c ON r.year = c.year AND r.is_rural = c.is_rural
                   LEFT JOIN ocuts o ON r.year = o.year AND r.is_rural = o.is_rural)"""


def _deserts(d: Domain):
    panel = stored(d.panel(), "panel")
    return cohorts.desert_labels(panel, ["year", "is_rural"], "n_lenders", "n_loans", "population", first_year=1998)


@query("a17_desert_flags", f"""WITH {DESERTS} SELECT tract_fips, year, is_service_desert, round(service_desert_score, 6) AS service_desert_score,
    round(per1k, 6) AS originations_per_1k, is_origination_desert, is_any_desert FROM labelled""")
def _(d: Domain):
    return rounded(_deserts(d).select("tract_fips", "year", "is_service_desert", "service_desert_score", "originations_per_1k",
                                      "is_origination_desert", "is_any_desert"))


FORWARD = DESERTS + """,
    ahead AS (SELECT a.tract_fips, a.year, a.is_rural, h.h, a.is_service_desert AS s0, a.is_any_desert AS a0, b.is_service_desert AS s1, b.is_any_desert AS a1
      FROM labelled a CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) h(h)
      LEFT JOIN labelled b ON b.tract_fips = a.tract_fips AND b.year = a.year + h.h)"""


def _forward(d: Domain):
    flags = ["is_service_desert", "is_any_desert"]
    return temporal.forward_labels(_deserts(d).select("tract_fips", "year", "is_rural", *flags), "tract_fips", "year", flags, [1, 2, 3, 4, 5, 6])


@query("a18_forward_labels", f"""WITH {FORWARD}
    SELECT tract_fips, year, max(s1) FILTER (h = 1) AS state_h1, max(s1) FILTER (h = 6) AS state_h6,
      max(CASE WHEN s0 = 0 THEN s1 END) FILTER (h = 1) AS becomes_h1, max(CASE WHEN s0 = 0 THEN s1 END) FILTER (h = 3) AS becomes_h3,
      max(CASE WHEN a0 = 0 THEN a1 END) FILTER (h = 3) AS becomes_any_h3 FROM ahead GROUP BY ALL""")
def _(d: Domain):
    return _forward(d).select(
        "tract_fips", "year", F.col("state_is_service_desert_h1").alias("state_h1"), F.col("state_is_service_desert_h6").alias("state_h6"),
        F.col("becomes_is_service_desert_h1").alias("becomes_h1"), F.col("becomes_is_service_desert_h3").alias("becomes_h3"),
        F.col("becomes_is_any_desert_h3").alias("becomes_any_h3"))


@query("j13_forward_self_join", f"""WITH {FORWARD}
    SELECT tract_fips, year, h AS horizon, s1 AS future_service, a1 AS future_any FROM ahead""")
def _(d: Domain):
    wide = _forward(d)
    entries = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"state_is_service_desert_h{h}").alias("future_service"),
                 F.col(f"state_is_any_desert_h{h}").alias("future_any")) for h in range(1, 7)])
    return wide.select("tract_fips", "year", F.explode(entries).alias("e")).select("tract_fips", "year", "e.*")


@query("a34_label_balance", f"""WITH {FORWARD}
    SELECT label, n_pos, n_labelled, round(n_pos / nullif(n_labelled, 0), 6) AS rate FROM (
      SELECT 'state_is_service_desert_h' || h AS label, count(*) FILTER (s1 = 1) AS n_pos, count(s1) AS n_labelled FROM ahead WHERE h <= 3 GROUP BY h
      UNION ALL SELECT 'becomes_is_service_desert_h' || h, count(*) FILTER (s0 = 0 AND s1 = 1), count(s1) FILTER (s0 = 0) FROM ahead WHERE h <= 3 GROUP BY h)""")
def _(d: Domain):
    labels = [f"{k}_is_service_desert_h{h}" for k in ("state", "becomes") for h in (1, 2, 3)]
    return rounded(evaluation.balance(_forward(d), [], labels))


@query("a35_flag_coverage", f"""WITH {LENDER_FLAGS}
    SELECT f.flag, count(f.v) AS n_known, count(*) FILTER (f.v = 1) AS n_flagged FROM (
      SELECT 'is_community_bank' AS flag, is_community_bank AS v FROM flags UNION ALL SELECT 'is_top4', is_top4 FROM flags
      UNION ALL SELECT 'is_credit_union', is_credit_union FROM flags) f GROUP BY ALL""")
def _(d: Domain):
    return serving.flag_coverage(_lender_flags(d), ["is_community_bank", "is_top4", "is_credit_union"])


@query("a31_investment_totals", """
    SELECT o_custkey AS tract_fips, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice / 1000.0::DOUBLE), 6) AS dollars_k, count(*) AS projects
    FROM orders GROUP BY ALL""")
def _(d: Domain):
    inv = d.table("orders").select(F.col("o_custkey").alias("tract_fips"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("dollars"))
    return rounded(rollups.investment_totals(inv, ["tract_fips", "year"]), 6)


@query("a32_coverage_by_year", """
    SELECT year, feature, round(avg(CAST(v > 0 AS INTEGER)), 6) AS share_positive, round(quantile_cont(v, 0.5), 4) AS median FROM (
      SELECT year, 'n_small' AS feature, n_small::DOUBLE AS v FROM d_panel UNION ALL SELECT year, 'amount_k', amount_k FROM d_panel
      UNION ALL SELECT year, 'population', population FROM d_panel WHERE population IS NOT NULL) GROUP BY ALL""")
def _(d: Domain):
    return rounded(serving.coverage(d.panel(), ["year"], ["n_small", "amount_k", "population"]), median=4)


@query("a36_hit_rate", """
    SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_ok, round(avg(CAST(lang = 'en' AS INTEGER)), 6) AS rate FROM documents GROUP BY ALL""")
def _(d: Domain):
    looked = d.table("documents").select("source", F.when(F.col("lang") == "en", "ok").otherwise("miss").alias("status"))
    return rounded(rollups.hit_rate(looked, ["source"]))


# ---------------------------------------------------------------- windows


@query("w01_row_number", """
    SELECT tract_fips, year, lender_id, rank FROM (SELECT tract_fips, year, lender_id,
      CAST(row_number() OVER (PARTITION BY tract_fips, year ORDER BY n_loans DESC, lender_id) AS INTEGER) AS rank FROM d_fact) WHERE rank <= 3""")
def _(d: Domain):
    return concentration.top_k_rows(d.fact().select("tract_fips", "year", "lender_id", "n_loans"), ["tract_fips", "year"], "n_loans", "lender_id", 3).drop("n_loans")


CONCENTRATION = """
    s AS (SELECT tract_fips, year, lender_id, n_loans, n_loans / sum(n_loans) OVER (PARTITION BY tract_fips, year) AS share,
            row_number() OVER (PARTITION BY tract_fips, year ORDER BY n_loans DESC, lender_id) AS rn, count_lt_100, count_100_250 FROM d_fact),
    c AS (SELECT tract_fips, year, count(DISTINCT lender_id) AS n, max(share) AS t1, sum(share) FILTER (rn <= 3) AS t3, sum(share * share) AS h,
            sum(count_lt_100) / sum(n_loans) AS u1, sum(count_lt_100 + count_100_250) / sum(n_loans) AS u2 FROM s GROUP BY ALL),
    g AS (SELECT tract_fips, year, n AS n_active_lenders_tract, CASE WHEN n >= 3 THEN t1 END AS top1_lender_share_tract,
            CASE WHEN n >= 3 THEN t3 END AS top3_lender_share_tract, CASE WHEN n >= 3 THEN h END AS lender_hhi_tract,
            u1 AS pct_loans_under_100k, u2 AS pct_loans_under_250k FROM c)"""
_names = concentration.CONCENTRATION_COLUMNS


@query("tract_year_concentration", f"""WITH {CONCENTRATION}
    SELECT tract_fips, year, n_active_lenders_tract, {', '.join(f'round({c}, 6) AS {c}' for c in _names)},
      {', '.join(f'round(avg({c}) OVER w, 6) AS {c}_lag2to5_mean' for c in _names)}
    FROM g WINDOW w AS (PARTITION BY tract_fips ORDER BY year ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING)""")
def _(d: Domain):
    return rounded(concentration.concentration(d.fact()))


@query("w02_trailing_mean", """
    SELECT tract_fips, year, round(avg(n_lenders) OVER w, 6) AS n_lenders_lag2to5_mean, round(avg(amount_k) OVER w, 4) AS amount_k_lag2to5_mean
    FROM d_panel WINDOW w AS (PARTITION BY tract_fips ORDER BY year ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING)""")
def _(d: Domain):
    p = d.panel().select("tract_fips", "year", "n_lenders", "amount_k")
    out = temporal.trailing_mean(p, "tract_fips", "year", ["n_lenders", "amount_k"], 2, 5)
    return rounded(out.drop("n_lenders", "amount_k"), amount_k_lag2to5_mean=4)


@query("w03_lagged_sums", """
    WITH b AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS z FROM orders),
    grid AS (SELECT t.tract_fips, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT o_custkey AS tract_fips FROM orders) t, (SELECT unnest(generate_series(a, z)) AS y FROM b)),
    t AS (SELECT g.tract_fips, g.year, coalesce(sum(o_totalprice), 0) AS dollars, count(o_orderkey) AS projects
          FROM grid g LEFT JOIN orders ON o_custkey = g.tract_fips AND year(o_orderdate) = g.year GROUP BY ALL)
    SELECT tract_fips, year, round(sum(dollars) OVER l, 2) AS dollars_lag2to6, round(sum(dollars) OVER s, 2) AS dollars_lag2to4,
      CAST(sum(projects) OVER l AS BIGINT) AS projects_lag2to6, CAST(coalesce(sum(dollars) OVER l, 0) > 0 AS INTEGER) AS received
    FROM t WINDOW l AS (PARTITION BY tract_fips ORDER BY year ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING),
                  s AS (PARTITION BY tract_fips ORDER BY year ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING)""")
def _(d: Domain):
    inv = d.table("orders").select(F.col("o_custkey").alias("tract_fips"), F.year("o_orderdate").alias("year"),
                                   F.col("o_totalprice").alias("dollars"), F.lit(1).alias("projects"))
    out = temporal.lagged_sums(inv, "tract_fips", "year", {
        "dollars_lag2to6": ("dollars", 2, 6), "dollars_lag2to4": ("dollars", 2, 4), "projects_lag2to6": ("projects", 2, 6)})
    received = U.flag(F.coalesce(F.col("dollars_lag2to6"), F.lit(0.0)) > 0)
    return rounded(out.withColumn("received", received).drop("dollars", "projects"), 2)


@query("w04_percentile_rank", """
    SELECT tract_fips, year, round((rank() OVER (PARTITION BY state_fips ORDER BY y_prob) + (count(*) OVER (PARTITION BY state_fips, y_prob) - 1) / 2.0::DOUBLE)
      / count(*) OVER (PARTITION BY state_fips) * 100.0::DOUBLE, 6) AS pct FROM d_scored""")
def _(d: Domain):
    ranked = orderstats.percentile_rank(d.scored().select("tract_fips", "year", "state_fips", "y_prob"), ["state_fips"], "y_prob", "pct")
    return rounded(ranked.select("tract_fips", "year", "pct"))


@query("w05_group_share", """
    SELECT area, tract_fips, round(overlap / sum(overlap) OVER (PARTITION BY area), 9) AS share FROM d_overlaps""")
def _(d: Domain):
    return rounded(cohorts.group_share(d.overlaps(), ["area"], "overlap", "share").drop("overlap"), 9)


@query("w06_peer_deviation", """
    SELECT tract_fips, year, round(y_prob - avg(y_prob) OVER (PARTITION BY year, is_rural), 6) + 0.0 AS deviation FROM d_scored""")
def _(d: Domain):
    s = d.scored().select("tract_fips", "year", "is_rural", "y_prob")
    return rounded(cohorts.group_mean_deviation(s, ["year", "is_rural"], "y_prob", "deviation").select("tract_fips", "year", "deviation"))


@query("w07_latest_row", """
    SELECT tract_fips, year, fold, round(y_prob, 6) AS y_prob FROM d_scored QUALIFY row_number() OVER (PARTITION BY tract_fips ORDER BY year DESC, fold DESC) = 1""")
def _(d: Domain):
    return rounded(temporal.latest_per_key(d.scored(), ["tract_fips"], ["year", "fold"], ["year", "fold", "y_prob"]))


@query("w08_group_zscore", """
    SELECT tract_fips, year, round((n_loans - avg(n_loans) OVER w) / CASE WHEN stddev_samp(n_loans) OVER w = 0 THEN 1 ELSE stddev_samp(n_loans) OVER w END, 6) + 0.0 AS n_loans_z
    FROM d_panel WINDOW w AS (PARTITION BY state_fips)""")
def _(d: Domain):
    return rounded(cohorts.group_zscores(d.panel().select("tract_fips", "year", "state_fips", "n_loans"), ["state_fips"], ["n_loans"]).select("tract_fips", "year", "n_loans_z"))


@query("w09_keep_first", """
    SELECT branch_id, year, lat, lon FROM d_branches QUALIFY row_number() OVER (PARTITION BY branch_id ORDER BY year) = 1""")
def _(d: Domain):
    return temporal.first_per_key(d.branches(), ["branch_id"], ["year"], ["year", "lat", "lon"])


# ---------------------------------------------------------------- the whole build


@query("panel_build", f"""WITH {CONCENTRATION},
    cuts AS (SELECT year, is_rural, quantile_cont(n_lenders::DOUBLE, 0.1) AS t FROM d_panel GROUP BY ALL),
    lab AS (SELECT p.tract_fips, p.year, p.is_rural, p.county_fips, p.n_lenders, CAST(p.n_lenders <= c.t AS INTEGER) AS is_service_desert
      FROM d_panel p JOIN cuts c ON p.year = c.year AND p.is_rural = c.is_rural),
    w AS (SELECT l.*, g.lender_hhi_tract AS y, ln(1 + n_lenders::DOUBLE) AS x1, n_lenders::DOUBLE AS x2 FROM lab l JOIN g ON g.tract_fips = l.tract_fips AND g.year = l.year),
    m AS (SELECT year, is_rural, count(y) AS n, avg(x1) FILTER (y IS NOT NULL) AS a1, avg(x2) FILTER (y IS NOT NULL) AS a2, avg(y) AS ay,
        var_pop(x1) FILTER (y IS NOT NULL) AS s11, var_pop(x2) FILTER (y IS NOT NULL) AS s22, covar_pop(x1, x2) FILTER (y IS NOT NULL) AS s12,
        covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM w GROUP BY ALL),
    v AS (SELECT y.year, max(d.vintage) AS vintage FROM (SELECT DISTINCT year FROM d_panel) y LEFT JOIN (SELECT DISTINCT vintage FROM d_demographics) d ON d.vintage <= y.year - 2 GROUP BY 1)
    SELECT w.tract_fips, w.year, w.n_lenders, round(g.top3_lender_share_tract, 6) AS top3_lender_share_tract, b.branch_count, v.vintage, i.households, w.is_service_desert,
      CASE WHEN w.is_service_desert = 0 THEN f.is_service_desert END AS becomes_is_service_desert_h1,
      CASE WHEN n >= 50 THEN round(y - ay - (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) * (x1 - a1) - (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) * (x2 - a2), 6) + 0.0 END AS lender_hhi_tract_resid
    FROM w JOIN g ON g.tract_fips = w.tract_fips AND g.year = w.year JOIN m ON m.year = w.year AND m.is_rural = w.is_rural JOIN v ON v.year = w.year
      LEFT JOIN lab f ON f.tract_fips = w.tract_fips AND f.year = w.year + 1
      LEFT JOIN (SELECT county_fips, year, count(*) AS branch_count FROM d_branches GROUP BY ALL) b ON b.county_fips = w.county_fips AND b.year = w.year
      LEFT JOIN d_demographics i ON i.tract_fips = w.tract_fips AND i.vintage = v.vintage""")
def _(d: Domain):
    from ..plans.panel import build_panel

    return rounded(build_panel(d).select(
        "tract_fips", "year", "n_lenders", "top3_lender_share_tract", "branch_count", "vintage", "households", "is_service_desert",
        "becomes_is_service_desert_h1", "lender_hhi_tract_resid"))
