"""The domain tables as SQL views, added in front of an oracle statement when it names them."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "d_places": """
        SELECT c_custkey AS tract_fips, c_nationkey AS county_fips, n_regionkey AS state_fips,
               CAST(c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') AS INTEGER) AS is_rural,
               CASE WHEN c_acctbal >= 0 THEN round(c_acctbal) END AS population,
               30.0::DOUBLE + (c_custkey * 7919 % 10000) / 1000.0::DOUBLE AS lat,
               -100.0::DOUBLE + (c_custkey * 104729 % 20000) / 1000.0::DOUBLE AS lon
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "d_fact": """
        SELECT o_custkey AS tract_fips, l_suppkey AS lender_id, CAST(year(o_orderdate) AS INTEGER) AS year,
               count(*) AS n_loans, sum(l_extendedprice) AS amount_k,
               count(*) FILTER (l_extendedprice < 25000) AS count_lt_100,
               count(*) FILTER (l_extendedprice >= 25000 AND l_extendedprice < 60000) AS count_100_250,
               count(*) FILTER (l_extendedprice >= 60000) AS count_250_1m,
               coalesce(sum(l_extendedprice) FILTER (l_extendedprice < 25000), 0) AS amount_lt_100,
               coalesce(sum(l_extendedprice) FILTER (l_extendedprice >= 25000 AND l_extendedprice < 60000), 0) AS amount_100_250,
               coalesce(sum(l_extendedprice) FILTER (l_extendedprice >= 60000), 0) AS amount_250_1m,
               c_nationkey AS county_fips, n_regionkey AS state_fips
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey
        GROUP BY o_custkey, l_suppkey, year(o_orderdate), c_nationkey, n_regionkey""",
    "d_panel": """
        SELECT f.tract_fips, f.year, count(DISTINCT lender_id) AS n_lenders, CAST(sum(n_loans) AS BIGINT) AS n_loans,
               sum(amount_k) AS amount_k, CAST(sum(count_lt_100) AS BIGINT) AS n_small,
               p.county_fips, p.state_fips, p.is_rural, p.population
        FROM d_fact f JOIN d_places p ON f.tract_fips = p.tract_fips
        GROUP BY f.tract_fips, f.year, p.county_fips, p.state_fips, p.is_rural, p.population""",
    "d_branches": """
        SELECT *, CAST(branch_id // 5 % 25 AS INTEGER) AS county_fips,
               30.0::DOUBLE + (branch_id * 6151 % 10000) / 1000.0::DOUBLE AS lat,
               -100.0::DOUBLE + (branch_id * 3571 % 20000) / 1000.0::DOUBLE AS lon
        FROM (SELECT l_partkey * 5 + l_suppkey % 5 AS branch_id, l_suppkey % 5 AS bank_id,
                     CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_extendedprice) AS deposits, count(*) AS n_accounts
              FROM lineitem GROUP BY 1, 2, 3)""",
    "d_demographics": """
        SELECT o_custkey AS tract_fips,
               CAST(CASE WHEN year(o_orderdate) <= 1996 THEN 1995 WHEN year(o_orderdate) = 1997 THEN 1997
                         WHEN year(o_orderdate) <= 1999 THEN 1998 ELSE 2000 END AS INTEGER) AS vintage,
               avg(o_totalprice) AS income, count(*) AS households
        FROM orders GROUP BY 1, 2""",
    "d_crosswalk_ab": """
        SELECT c_custkey AS src, c_custkey AS dst, 0.6::DOUBLE AS weight FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT c_custkey, c_custkey + 1, 0.4 FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT c_custkey, c_custkey + 1, 1.0 FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "d_crosswalk_bc": """
        SELECT c_custkey AS src, c_custkey AS dst, 0.7::DOUBLE AS weight FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
        UNION ALL SELECT c_custkey, c_custkey + 2, 0.3 FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
        UNION ALL SELECT c_custkey, c_custkey + 3, 1.0 FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "d_overlaps": """
        SELECT l_partkey AS area, o_custkey AS tract_fips, sum(l_quantity) AS overlap
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "d_loans": """
        SELECT state_fips, o_custkey AS zip, CAST(year(o_orderdate) AS INTEGER) AS year,
               CASE WHEN o_orderstatus = 'F' THEN '504' ELSE '7a' END AS program,
               CASE WHEN o_orderpriority LIKE '5%' THEN '  ' ELSE o_orderpriority END AS lender,
               o_totalprice AS gross, o_totalprice * 0.75::DOUBLE AS guaranteed
        FROM orders JOIN d_places ON o_custkey = tract_fips""",
    "d_applications": """
        SELECT event_id, ts, user_id AS tract_fips, CAST(ts AS DATE) AS period,
               CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'click' THEN 4
                               WHEN 'signup' THEN 6 END AS action,
               value AS amount, CASE WHEN event_id % 37 = 0 THEN '' ELSE 'L' || (event_id % 37) END AS lender,
               CASE WHEN k < 40 THEN 'White' WHEN k < 60 THEN 'Black or African American' WHEN k < 75 THEN 'Asian'
                    WHEN k < 90 THEN 'Other' ELSE '' END AS race,
               CASE WHEN k % 5 = 0 THEN 'Hispanic or Latino' ELSE 'Not Hispanic or Latino' END AS ethnicity
        FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "d_scored": """
        SELECT *, 'F' || (tract_fips % 4 + 1) AS fold, CAST(n_lenders <= 2 AS INTEGER) AS y_true,
               least(0.6::DOUBLE * ((tract_fips * 7919 + year * 31) % 100 / 100.0::DOUBLE)
                     + 0.4::DOUBLE / CAST(n_lenders + 1 AS DOUBLE), 1.0::DOUBLE) AS y_prob,
               least(0.6::DOUBLE * ((tract_fips * 4409 + year * 17) % 100 / 100.0::DOUBLE)
                     + 0.4::DOUBLE / CAST(n_lenders + 1 AS DOUBLE), 1.0::DOUBLE) AS y_prob2
        FROM d_panel""",
    "d_features": """
        SELECT * FROM d_panel QUALIFY row_number() OVER (PARTITION BY tract_fips ORDER BY year DESC) = 1""",
    "d_risks": """
        SELECT s.tract_fips, s.county_fips, s.state_fips, s.population, s.is_rural, s.y_true, m.model,
               CASE m.model WHEN 'm1_h3' THEN y_prob WHEN 'm1_h6' THEN y_prob * 0.5::DOUBLE
                            WHEN 'm2_h3' THEN y_prob2 ELSE y_prob2 * 0.5::DOUBLE END AS risk
        FROM (SELECT * FROM d_scored QUALIFY row_number() OVER (PARTITION BY tract_fips ORDER BY year DESC, fold DESC) = 1) s
             CROSS JOIN (VALUES ('m1_h3'), ('m1_h6'), ('m2_h3'), ('m2_h6')) m(model)""",
    "d_drivers": """
        SELECT f.tract_fips, f.county_fips, f.state_fips, m.model, x.feature,
               CASE x.feature
                    WHEN 'lender_hhi_tract_resid' THEN (8.0::DOUBLE - n_lenders) * (0.1::DOUBLE * m.scale)
                    WHEN 'branches_within_5mi' THEN (10.0::DOUBLE - n_loans) * (0.05::DOUBLE * m.scale)
                    WHEN 'pct_poverty' THEN (amount_k - 300000.0::DOUBLE) * (0.000002::DOUBLE * m.scale)
                    ELSE (n_small - 3.0::DOUBLE) * (0.08::DOUBLE * m.scale) END AS attribution
        FROM d_features f
             CROSS JOIN (VALUES ('m1_h3', 1.0::DOUBLE), ('m1_h6', 0.5), ('m2_h3', 1.5), ('m2_h6', 0.75)) m(model, scale)
             CROSS JOIN (VALUES ('lender_hhi_tract_resid'), ('branches_within_5mi'), ('pct_poverty'), ('population')) x(feature)""",
    "d_reporters": """
        SELECT p_partkey AS reporter_id, 'The ' || p_name || ' ' || p_type || ' Corp.' AS name, p_brand AS state,
               'C' || (p_size % 7) AS city, p_retailprice AS amount FROM part""",
    "d_institutions": """
        SELECT p_partkey AS institution_id,
               CASE p_size % 3 WHEN 0 THEN p_name || ' ' || p_type || ' Bank'
                               WHEN 1 THEN replace(p_name, 'o', '0') || ' ' || p_type
                               ELSE p_type || ', ' || p_name || ' Trust' END AS name,
               p_brand AS state, 'C' || (p_size % 7) AS city FROM part""",
}


def _needed(sql: str, seen: list[str]) -> None:
    for name, body in VIEWS.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(body, seen)
            if name not in seen:
                seen.append(name)


def with_views(sql: str) -> str:
    """``sql`` with the definitions of the domain views it uses in front."""
    seen: list[str] = []
    _needed(sql, seen)
    if not seen:
        return sql.strip()
    defs = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in seen)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {defs},\n{body[5:]}"
    return f"WITH {defs}\n{body}"
