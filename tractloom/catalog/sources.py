"""Queries on files: the tables are written in a source's format and read back, or parsed from derived lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import pad_left
from ..operators import rollups, serving
from ..plans.dashboard import county_documents
from ..plans.domain import Domain
from ..session import fresh_path, stored
from ..sources import disclosure, programs, roster, sinks, tables
from .registry import query, rounded


def _pad(c, width: int):
    return F.lpad(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), width, "0")


def _stored_lines(d: Domain):
    """Both kinds of lines in one table, as a reader meets them.

    They are made from one build of the fact and written down: each field of a parser would else build its line again.
    """
    fact = stored(d.fact().select("tract_fips", "county_fips", "state_fips", "lender_id", "year", *rollups.BUCKETS), "fact")
    return stored(_presence_lines(fact).unionByName(_totals_lines(fact)), "lines")


def _presence_lines(f: DataFrame):
    tract = F.concat(F.substring(_pad("tract_fips", 6), 1, 4), F.lit("."), F.substring(_pad("tract_fips", 6), 5, 2))
    return f.select(F.concat(
        F.lit("D6-0 "), _pad("lender_id", 10), F.col("lender_id") % 5, F.col("year"), _pad("state_fips", 2), _pad("county_fips", 3),
        F.lit("     "), tract, F.lit(" " * 10), F.when(F.col("count_lt_100") > 0, "Y").otherwise("N")).alias("line"), "year")


def _totals_lines(fact: DataFrame):
    f = rollups.bucket_totals(fact, ["state_fips", "county_fips", "lender_id", "year"])
    measures = [F.lpad(F.format_string("%.0f", F.col(m).cast("double")), 10, " ") for m in rollups.BUCKETS]
    level = F.when(F.col("lender_id") % 3 == 0, "060").otherwise("040")
    body = F.concat(F.lit("D1-1 "), _pad("lender_id", 10), F.col("lender_id") % 5, F.lit("202400"), _pad("state_fips", 2), _pad("county_fips", 3),
                    F.lit(" " * 15), level, *measures, F.lit("." * 40))
    return f.select(body.alias("line"), "year")


@query("s01_disclosure_presence", """
    SELECT DISTINCT lpad(CAST(state_fips AS VARCHAR), 2, '0') || lpad(CAST(county_fips AS VARCHAR), 3, '0') AS county_fips, (lender_id % 5) || '_' || lpad(CAST(lender_id AS VARCHAR), 10, '0') AS lender_id, year,
      lpad(CAST(state_fips AS VARCHAR), 2, '0') || lpad(CAST(county_fips AS VARCHAR), 3, '0') || lpad(CAST(tract_fips AS VARCHAR), 6, '0') AS tract_fips FROM d_fact WHERE count_lt_100 > 0""")
def _(d: Domain):
    return disclosure.parse_presence(_stored_lines(d))


@query("s01_disclosure_totals", """
    SELECT lpad(CAST(state_fips AS VARCHAR), 2, '0') || lpad(CAST(county_fips AS VARCHAR), 3, '0') AS county_fips, (lender_id % 5) || '_' || lpad(CAST(lender_id AS VARCHAR), 10, '0') AS lender_id, year,
      CAST(sum(count_lt_100) AS BIGINT) AS count_lt_100, CAST(sum(count_100_250) AS BIGINT) AS count_100_250, CAST(sum(count_250_1m) AS BIGINT) AS count_250_1m
    FROM d_fact WHERE lender_id % 3 <> 0 GROUP BY ALL""")
def _(d: Domain):
    parsed = disclosure.parse_totals(_stored_lines(d))
    return parsed.drop("amount_lt_100", "amount_100_250", "amount_250_1m")


@query("s02_transmittal", """
    SELECT (s_nationkey % 5) || '_' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS lender_id, CAST(s_nationkey % 5 AS VARCHAR) AS agency_code, 2020 AS activity_year, s_name AS name,
      s_suppkey || ' High St' AS street, 'NATION_' || s_nationkey AS city, 'ST' AS state, '12345-0000' AS zip FROM supplier""")
def _(d: Domain):
    s = F.col("s_suppkey")
    line = F.concat(_pad("s_suppkey", 10), F.col("s_nationkey") % 5, F.lit("2020"), F.rpad("s_name", 30, " "), F.rpad(F.concat(s, F.lit(" High St")), 40, " "),
                    F.rpad(F.concat(F.lit("NATION_"), F.col("s_nationkey")), 25, " "), F.lit("ST"), F.lit("12345-0000"))
    return disclosure.parse_transmittal(d.table("supplier").select(line.alias("line"), F.lit(1999).alias("year")))


@query("s03_discovery", """
    SELECT y AS year, CAST(p.kind = 'discl' AS BOOLEAN) AS wanted, count(*) AS n_lines FROM d_fact, (VALUES ('discl')) p(kind), (VALUES (2019), (2020)) g(y) GROUP BY ALL""")
def _(d: Domain):
    root = fresh_path(d.spark, "landing")
    lines = _presence_lines(d.fact()).select("line")
    for year in (2019, 2020):
        lines.write.text(f"{root}/{year}/discl")
        d.table("nation").select("n_name").write.text(f"{root}/{year}/trans")
    found = disclosure.discover(d.spark, root, "discl", [2019, 2020])
    read = disclosure.read_lines(d.spark, f"{root}/*/discl/*.txt")
    years = found.select("year").distinct().withColumn("wanted", F.lit(True))
    return read.join(years, "year").groupBy("year", "wanted").agg(F.count(F.lit(1)).alias("n_lines"))


@query("s04_branch_files", """
    SELECT CAST(branch_id AS VARCHAR) AS branch_id, CAST(bank_id AS VARCHAR) AS cert, CAST(NULL AS VARCHAR) AS rssd, lpad(CAST(county_fips AS VARCHAR), 5, '0') AS county_fips,
      round(deposits, 2) AS deposits, round(lat, 6) AS lat, round(lon, 6) AS lon, year FROM d_branches""")
def _(d: Domain):
    path = fresh_path(d.spark, "branch-files")
    d.branches().select(
        F.col("branch_id").alias("UNINUMBR"), F.col("bank_id").alias("CERT"), F.col("county_fips").alias("STCNTYBR"),
        F.format_number("deposits", 2).alias("DEPSUMBR"), F.col("lat").alias("SIMS_LATITUDE"), (F.col("lon")).alias("SIMS_LONGITUDE"), "year",
    ).write.partitionBy("year").option("header", "true").csv(path)
    # the synthetic points lie east of the coverage's western half, all inside its bounds
    return rounded(tables.read_branches(d.spark, path))


@query("s05_header_json", """
    SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS tract_fips, 2020 AS vintage,
      CAST(c_custkey AS DOUBLE) AS population, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal) END AS median_hh_income FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(d: Domain):
    header = F.array(*[F.lit(x) for x in ("B01003_001E", "B19013_001E", "state", "county", "tract")])
    income = F.when(F.col("c_acctbal") >= 0, F.round("c_acctbal").cast("string")).otherwise("-666666666")
    row = F.array(F.col("c_custkey").cast("string"), income, F.col("n_regionkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    docs = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.to_json(F.array(header, row)).alias("value"), F.lit(2020).alias("vintage"))
    return tables.survey_estimates(tables.parse_header_json(docs)).select("tract_fips", "vintage", "population", "median_hh_income")


@query("s06_loan_files", """
    SELECT 'ST' AS state, lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS zip5, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderstatus = 'F' THEN '504' ELSE '7a' END AS program,
      o_orderpriority AS lender, o_totalprice AS gross, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END::DOUBLE AS guaranteed FROM orders""")
def _(d: Domain):
    o = d.table("orders")
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    a, b = fresh_path(d.spark, "loans-7a"), fresh_path(d.spark, "loans-504")
    base = [F.lit("st ").alias("borrstate"), F.concat(_pad(F.col("o_custkey") % 100000, 5), F.lit("-0000")).alias("borrzip")]
    o.where("o_orderstatus <> 'F'").select(
        *base, F.date_format("o_orderdate", "MM/dd/yyyy").alias("approvaldate"), money.alias("grossapproval"), money.alias("sbaguaranteedapproval"),
        F.col("o_orderpriority").alias("bankname")).write.option("header", "true").csv(a)
    o.where("o_orderstatus = 'F'").select(
        F.col("o_orderpriority").alias("cdc_name"), *base, F.date_format("o_orderdate", "yyyy-MM-dd").alias("approvaldate"), money.alias("grossapproval"),
    ).write.option("header", "true").csv(b)
    return tables.read_loans(d.spark, a, b, 1990, 2024)


@query("s07_state_files", """
    SELECT CAST(tract_fips AS VARCHAR) AS tract_fips, count(*) AS n_applications, count(*) FILTER (action = 1) AS n_originated, count(*) FILTER (action = 3) AS n_denied, CAST(NULL AS DOUBLE) AS approval_rate, 2024 AS year
    FROM d_applications WHERE action IS NOT NULL GROUP BY 1""")
def _(d: Domain):
    path = fresh_path(d.spark, "applications")
    counts = rollups.application_counts(d.applications(), ["tract_fips"]).select("tract_fips", "n_applications", "n_originated", "n_denied")
    counts.write.option("header", "true").csv(f"{path}/tract_aggregates_2024")
    return tables.read_state_aggregates(d.spark, f"{path}/tract_aggregates_*")


@query("s08_crosswalk_files", """
    SELECT lpad(CAST(src AS VARCHAR), 11, '0') AS src, lpad(CAST(dst AS VARCHAR), 11, '0') AS dst, round(weight, 9) AS weight, 'old' AS kind FROM d_crosswalk_ab
    UNION ALL SELECT lpad(CAST(src AS VARCHAR), 11, '0'), lpad(CAST(dst AS VARCHAR), 11, '0'), round(weight, 9), 'new' FROM d_crosswalk_bc""")
def _(d: Domain):
    blank = F.lit("0")
    ab, bc = d.crosswalk_ab(), d.crosswalk_bc()
    src, dst, w = F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight")
    old = [blank] * 27
    old[3], old[12], old[25] = src, dst, (w * 100.0).cast("string")
    new = [blank] * 16
    new[1], new[8], new[10], new[14] = dst, src, F.lit("1000.0"), (w * 1000.0).cast("string")
    a = tables.parse_old_crosswalk(ab.select(F.split(F.concat_ws(",", *old), ",").alias("f"))).withColumn("kind", F.lit("old"))
    b = tables.parse_new_crosswalk(bc.select(F.split(F.concat_ws("|", *new), r"\|").alias("f"))).withColumn("kind", F.lit("new"))
    return rounded(a.unionByName(b), 9)


@query("s09_zip_area_files", """
    SELECT CAST(area AS VARCHAR) AS area, lpad(CAST(tract_fips AS VARCHAR), 11, '0') AS tract_fips, CAST(overlap AS BIGINT) AS overlap,
      round(overlap / sum(overlap) OVER (PARTITION BY area), 9) AS weight FROM d_overlaps""")
def _(d: Domain):
    row = [F.lit("x")] * 16
    row[1], row[9], row[15] = F.col("area").cast("string"), F.col("tract_fips").cast("string"), F.col("overlap").cast("long").cast("string")
    return rounded(tables.parse_zip_areas(d.overlaps().select(F.split(F.concat_ws("|", *row), r"\|").alias("f"))), 9)


@query("s10_county_names", "SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county_fips, n_name || ', ST' AS label FROM nation")
def _(d: Domain):
    path = fresh_path(d.spark, "counties")
    line = F.concat_ws("|", F.lit("ST"), _pad("n_regionkey", 2), _pad("n_nationkey", 3), F.lit("0"), F.col("n_name"), F.lit("H1"))
    d.table("nation").select(line.alias("value")).write.text(path)
    return tables.read_county_names(d.spark, path)


@query("s11_gazetteer", """
    SELECT lpad(CAST(tract_fips AS VARCHAR), 11, '0') AS tract_fips, lat, lon FROM d_places""")
def _(d: Domain):
    path = fresh_path(d.spark, "gazetteer")
    d.places().select(F.lit("ST").alias("USPS"), F.col("tract_fips").alias("GEOID"), F.col("lat").alias("INTPTLAT"),
                      F.concat("lon", F.lit(" ")).alias("INTPTLONG ")).write.options(header="true", sep="\t").csv(path)
    return tables.read_tract_centroids(d.spark, path)


@query("s11_places_index", """
    SELECT c_custkey AS place_id, 'Place ' || c_custkey AS name, n_name AS state, c_acctbal * 10 AS population, lat, lon FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN d_places ON tract_fips = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal * 10 >= 10000""")
def _(d: Domain):
    code = F.when(F.col("c_mktsegment") == "BUILDING", "C1").when(F.col("c_mktsegment") == "MACHINERY", "U1").otherwise("S1")
    kind = F.when(F.col("c_custkey") % 2 == 0, " city").otherwise(" CDP")
    c = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    places = c.select(F.col("c_custkey").alias("place_id"), F.concat(F.lit("Place "), F.col("c_custkey"), kind).alias("name"), F.col("n_name").alias("state"), code.alias("class_code"))
    located = places.join(d.places().select(F.col("tract_fips").alias("place_id"), "lat", "lon"), "place_id")
    people = d.table("customer").select(F.col("c_custkey").alias("place_id"), (F.col("c_acctbal") * 10).alias("population"))
    return tables.places_index(located, people)


@query("s12_ragged_sheet", """
    SELECT CAST(s_nationkey AS VARCHAR) AS file, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier""")
def _(d: Domain):
    s = d.table("supplier")
    n = F.col("s_nationkey")
    data = s.select(n.cast("string").alias("file"), (F.col("s_suppkey") + 10).cast("int").alias("line"), F.array(F.concat("s_suppkey", F.lit(".0")), "s_name").alias("cells"))
    again = data.select("file", (F.col("line") + 1000000).alias("line"), "cells")
    top = s.select(n.cast("string").alias("file")).distinct()
    def fixed(at, *cells):
        return top.select("file", F.lit(at).alias("line"), F.array(*[F.lit(c) for c in cells]).alias("cells"))

    sheet = data.unionByName(again).unionByName(fixed(1, "Institutions", "")).unionByName(fixed(3, "Certificate Number", "Name")).unionByName(fixed(2000000, "Total", ""))
    out = roster.ragged_sheet(sheet, ["file"], "line", "cells")
    return out.select("file", "id", F.col("cells")[1].alias("name"))


@query("s13_roster_columns", "SELECT s_name AS name, CAST(s_nationkey AS VARCHAR) AS state, CAST(s_suppkey AS VARCHAR) AS rssd FROM supplier")
def _(d: Domain):
    raw = d.table("supplier").select(
        F.col("s_name").alias(" Organization Name "), F.col("s_nationkey").cast("string").alias("STALP"), F.col("s_suppkey").cast("string").alias("FED_RSSD"),
        F.col("s_acctbal").alias("Assets"))
    return roster.standard_columns(raw)


@query("s17_program_panel", """
    WITH y AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS z FROM orders), g AS (SELECT DISTINCT n_regionkey AS state_fips FROM nation),
    p AS (SELECT state_fips, CAST(unnest(generate_series(a, z)) AS INTEGER) AS year, a FROM g, y)
    SELECT state_fips, year, CAST(year BETWEEN a + 2 AND a + 8 AS INTEGER) AS active, 0 AS second_era_active, CASE WHEN year >= a + 2 THEN 3 ELSE 0 END AS program_count,
      CASE WHEN year >= a + 2 THEN 3 ELSE 0 END AS n_credit_programs, CASE WHEN year >= a + 2 THEN 'first' ELSE 'none' END AS era_label FROM p""")
def _(d: Domain):
    year = F.year("o_orderdate")
    first, last = (d.table("orders").agg(f(year)).scalar() for f in (F.min, F.max))
    states = d.table("nation").select(F.col("n_regionkey").alias("state_fips"))
    return programs.program_panel(states, first, last, first - 2009)


@query("s18_projected_scan", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= DATE '2000-01-01' AND l_quantity > 40")
def _(d: Domain):
    return d.table("lineitem").where((F.col("l_shipdate") >= F.lit("2000-01-01").cast("date")) & (F.col("l_quantity") > 40)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("s19_table_sinks", "SELECT tract_fips, year, n_lenders, n_loans, 'parquet' AS kind FROM d_panel UNION ALL SELECT tract_fips, year, n_lenders, n_loans, 'csv' FROM d_panel")
def _(d: Domain):
    panel = d.panel().select("tract_fips", "year", "n_lenders", "n_loans")
    a, b = fresh_path(d.spark, "sink-parquet"), fresh_path(d.spark, "sink-csv")
    sinks.write_table(panel, a, ["tract_fips"])
    sinks.write_table(d.spark.read.parquet(a), b, ["tract_fips"], fmt="csv")
    schema = "tract_fips long, n_lenders long, n_loans long, year int"
    back = d.spark.read.schema(schema).option("header", "true").csv(b)
    order = ["tract_fips", "year", "n_lenders", "n_loans"]
    return d.spark.read.parquet(a).select(*order, F.lit("parquet").alias("kind")).unionByName(back.select(*order, F.lit("csv").alias("kind")))


@query("s19_head_sink", "SELECT tract_fips, year, n_lenders, n_loans FROM d_panel ORDER BY tract_fips, year LIMIT 50")
def _(d: Domain):
    path = fresh_path(d.spark, "head")
    sinks.write_head(d.panel().select("tract_fips", "year", "n_lenders", "n_loans").orderBy("tract_fips", "year"), path)
    return d.spark.read.schema("tract_fips long, year int, n_lenders long, n_loans long").option("header", "true").csv(path)


@query("s20_county_documents")
def _(d: Domain):
    path = fresh_path(d.spark, "documents")
    docs = county_documents(d)
    sinks.write_json(docs, path)
    return d.spark.read.schema(docs.schema).json(path)


@query("s21_keyed_records", "SELECT tract_fips, round(amount_k, 4) AS amount_k, CAST(n_lenders AS DOUBLE) AS n_lenders, population FROM d_features")
def _(d: Domain):
    path = fresh_path(d.spark, "records")
    sinks.write_json(sinks.keyed_records(d.features(), "tract_fips", ["amount_k", "n_lenders", "population"]), path, gzip=True)
    back = d.spark.read.schema("tract_fips long, record string").json(path)
    parsed = F.from_json("record", "amount_k double, n_lenders double, population double")
    return back.select("tract_fips", parsed.alias("r")).select("tract_fips", "r.*")


@query("s22_point_features", "SELECT branch_id, year, round(lon, 5) AS lon, round(lat, 5) AS lat, round(deposits, 2) AS deposits FROM d_branches")
def _(d: Domain):
    lines = sinks.point_features(d.branches().withColumn("deposits", F.round("deposits", 2)), ["branch_id", "year"], "deposits")
    def at(p):
        return F.get_json_object("value", p)

    return lines.select(
        at("$.properties.branch_id").cast("long").alias("branch_id"), at("$.properties.year").cast("int").alias("year"),
        at("$.geometry.coordinates[0]").cast("double").alias("lon"), at("$.geometry.coordinates[1]").cast("double").alias("lat"),
        at("$.properties.deposits").cast("double").alias("deposits"))


def place_features(d: Domain):
    """A GeoJSON collection per place: every third one has several parts, one with a hole, every third a line, the rest one ring."""
    def ring(dx: float, size: float):
        return "[" + ", ".join(f"[{{lon+{dx + x}}}, {{lat+{y}}}]" for x, y in [(0, 0), (size, 0), (size, size), (0, 0)]) + "]"

    def filled(template: str):
        parts = re.split(r"\{(lon|lat)\+([0-9.]+)\}", template)
        texts = [F.lit(parts[0])]
        for name, add, rest in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
            texts += [(F.col(name) + float(add)).cast("string"), F.lit(rest)]
        return F.concat(*texts)

    several = filled(f'{{"type": "MultiPolygon", "coordinates": [[{ring(0, 1)}, {ring(0.25, 0.5)}], [{ring(2, 0.5)}]]}}')
    line = filled('{"type": "LineString", "coordinates": [[{lon+0}, {lat+0}], [{lon+1}, {lat+1}]]}')
    single = filled(f'{{"type": "Polygon", "coordinates": [{ring(0, 1)}]}}')
    kind = F.col("tract_fips") % 3
    geometry = F.when(kind == 0, several).when(kind == 1, line).otherwise(single)
    feature = F.concat(F.lit('{"type": "Feature", "properties": {"GEOID": "'), F.col("tract_fips").cast("string"), F.lit('"}, "geometry": '), geometry, F.lit("}"))
    return d.places().select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), feature, F.lit("]}")).alias("value"))


@query("s23_feature_attributes", """
    SELECT tract_fips, n_lenders, CASE tract_fips % 3 WHEN 0 THEN 'MultiPolygon' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS kind,
      CASE tract_fips % 3 WHEN 0 THEN 12 WHEN 1 THEN 2 ELSE 4 END::BIGINT AS n_positions, round(lon + CASE tract_fips % 3 WHEN 0 THEN 2.5 ELSE 1 END, 6) AS max_lon
    FROM d_features JOIN d_places USING (tract_fips)""")
def _(d: Domain):
    out = sinks.attach_properties(place_features(d), d.features().select("tract_fips", "n_lenders"), "tract_fips", "GEOID")
    geometry = sinks.parsed_features(out).select(
        F.element_at("f.properties", "tract_fips").cast("long").alias("tract_fips"), F.element_at("f.properties", "n_lenders").cast("long").alias("n_lenders"), "f.geometry")
    positions = F.regexp_count(F.variant_get("geometry", "$.coordinates", "string"), F.lit(r"\[-?\d"))
    return rounded(geometry.select("tract_fips", "n_lenders", F.variant_get("geometry", "$.type", "string").alias("kind"), positions.cast("long").alias("n_positions"),
                                   serving.geometry_bounds("geometry")["max_lon"].alias("max_lon")))
