"""Queries on text: addresses, slugs, page fragments, record profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..plans.domain import Domain
from ..sources import drift, roster
from .registry import query


@query("p16_address_key", """
    WITH a AS (SELECT c_custkey, upper(trim(c_name) || CASE WHEN c_acctbal >= 0 THEN ', ' || c_mktsegment ELSE '' END || ', nation ' || c_nationkey) AS line FROM customer)
    SELECT c_custkey, line, sha1(line) AS key FROM a""")
def _(d: Domain):
    parts = [F.concat(F.lit(" "), F.col("c_name")), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("  "),
             F.concat(F.lit("nation "), F.col("c_nationkey"))]
    return d.table("customer").select("c_custkey", C.address_line(*parts).alias("line"), C.address_key(*parts).alias("key"))


@query("s14_roster_keys", """
    SELECT p_partkey, regexp_replace(upper(regexp_replace(trim(p_name || ' & _' || p_brand || '_(' || p_type || ')'), '\\W+', '_', 'g')), '^_+|_+$', '', 'g') AS roster_id,
      CAST(p_partkey AS VARCHAR) AS rssd, CAST(current_date AS DATE) AS snapshot_date FROM part""")
def _(d: Domain):
    raw = d.table("part").select(
        "p_partkey", F.concat(F.col("p_name"), F.lit(" & ")).alias("name"), "p_brand", F.concat(F.lit("("), F.col("p_type"), F.lit(")")).alias("kind"),
        F.concat(F.col("p_partkey"), F.lit(".0")).alias("rssd"))
    return roster.roster_keys(raw, "name", "p_brand", "kind").select("p_partkey", "roster_id", "rssd", "snapshot_date")


@query("s15_page_links", """
    SELECT page_id, href, text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href,
      trim(unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2))) AS text FROM pages)""")
def _(d: Domain):
    return roster.html_links(d.table("pages"), "page_id")


@query("s15_listing_cards", """
    SELECT c_name AS name, CAST(c_custkey AS VARCHAR) || ' Main St' AS address, c_mktsegment AS city, n_name AS state, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip, 'serves ' || n_name AS states_served
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT 'Office of ' || n_name, '1 Plaza', 'Capital', n_name, '00001', '' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(d: Domain):
    def card(name, address, city, state, zip_, served):
        def tag(css, value):
            return F.concat(F.lit(f'<div class="x {css}"><b>'), value, F.lit("</b></div>"))

        return F.concat(
            F.lit('<div class="node sba-card-styled-listing contact">'), tag("views-field-title", name),
            F.lit('<p class="address">'), tag("address-line1", address), tag("locality", city), tag("administrative-area", state),
            tag("postal-code", zip_), F.lit("</p>"), tag("views-field-field-contact-states-served", served), F.lit("</div>"))

    rows = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = F.col("n_name")
    own = card(F.col("c_name"), F.concat(F.col("c_custkey"), F.lit(" Main St")), F.col("c_mktsegment"), n,
               F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"), F.concat(F.lit("serves "), n))
    office = card(F.concat(F.lit("Office of "), n), F.lit("1 Plaza"), F.lit("Capital"), n, F.lit("00001"), F.lit(""))
    pages = rows.select(F.concat(F.lit("<html><body>"), own, office, F.lit("</body></html>")).alias("html"))
    return roster.parse_listing(pages)


@query("s16_html_stub", """
    SELECT 'page' AS kind, page_id AS id, regexp_matches(substr(html, 1, 64), '^\\s*<') AS is_stub FROM pages
    UNION ALL SELECT 'document', doc_id, regexp_matches(substr(text, 1, 64), '^\\s*<') FROM documents""")
def _(d: Domain):
    pages = d.table("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), C.is_html_stub("html").alias("is_stub"))
    docs = d.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), C.is_html_stub("text").alias("is_stub"))
    return pages.unionByName(docs)


@query("s24_record_profile", """
    WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT source, trim(substr(line, 1, 2)) AS record_type, count(*) AS n, CAST(min(length(line)) AS INTEGER) AS min_length, CAST(max(length(line)) AS INTEGER) AS max_length FROM l GROUP BY ALL""")
def _(d: Domain):
    lines = d.table("documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return drift.record_profile(lines, ["source"], prefix=2)


@query("s24_schema_drift", """
    WITH t AS (SELECT o_orderpriority AS source, CAST(year(o_orderdate) AS INTEGER) AS year, list_sort(list(DISTINCT o_orderstatus || month(o_orderdate))) AS columns, count(*) AS n_rows FROM orders GROUP BY 1, 2),
    a AS (SELECT source, max_by(columns, year) AS anchor, max(year) AS anchor_year FROM t GROUP BY 1)
    SELECT t.source, t.year, anchor_year, n_rows, CAST(len(columns) AS INTEGER) AS n_columns,
      array_to_string(list_sort(list_filter(columns, lambda c: NOT list_contains(anchor, c))), ',') AS added,
      array_to_string(list_sort(list_filter(anchor, lambda c: NOT list_contains(columns, c))), ',') AS removed FROM t JOIN a ON a.source = t.source""")
def _(d: Domain):
    tables = d.table("orders").groupBy(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year")).agg(
        F.sort_array(F.collect_set(F.concat("o_orderstatus", F.month("o_orderdate")))).alias("columns"), F.count(F.lit(1)).alias("n_rows"))
    out = drift.schema_drift(tables)
    return out.withColumns({c: F.array_join(c, ",") for c in ("added", "removed")})
