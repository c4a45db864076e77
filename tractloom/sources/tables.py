"""Delimited, JSON and gazetteer files with declared schemas."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import census_number, money, pad_left, year_of_date
from ..functions.geo import in_coverage
from ..operators.cohorts import group_share

BRANCH_COLUMNS = {
    "UNINUMBR": "branch_id", "CERT": "cert", "RSSDID": "rssd", "STCNTYBR": "county", "DEPSUMBR": "deposits",
    "SIMS_LATITUDE": "lat", "SIMS_LONGITUDE": "lon",
}


def path_year(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("int")


def read_named_csv(spark: SparkSession, paths: str | list[str], columns: dict[str, str], year_pattern: str | None = None, **options: str) -> DataFrame:
    """Text columns of CSV files picked by header name, as a union over ``paths``.

    Give one path (or glob) per file layout: each is matched by its own header, so layouts may order or extend their
    columns freely, and a column a layout lacks becomes NULL. A file that departs from its path's layout fails the
    read instead of shifting columns. With ``year_pattern`` the year is taken from the file path.
    """
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        df = spark.read.options(header="true", enforceSchema="false", **options).csv(path)
        have = {c.strip().lstrip("\ufeff").lower(): c for c in df.columns}
        picked = [
            (F.col(f"`{have[src.lower()]}`").cast("string") if src.lower() in have else F.lit(None).cast("string")).alias(dst)
            for src, dst in columns.items()
        ]
        parts.append(df.select(*picked, *([path_year(year_pattern).alias("year")] if year_pattern else [])))
    return reduce(DataFrame.unionByName, parts)


# the year in a file name such as sod_2020.csv or a directory such as year=2020
FILE_YEAR = r"(?:_|year=)([0-9]{4})(?:\.csv|/)"


def read_branches(spark: SparkSession, *paths: str) -> DataFrame:
    """Branch list per year (year from the file name) with usable coordinates only."""
    raw = read_named_csv(spark, list(paths), BRANCH_COLUMNS, FILE_YEAR)
    typed = raw.select(
        "branch_id", "cert", "rssd", pad_left(F.trim("county"), 5).alias("county_fips"), money("deposits").alias("deposits"),
        F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), "year",
    )
    return typed.where(in_coverage("lat", "lon"))


def read_market_branches(spark: SparkSession, *paths: str) -> DataFrame:
    """Branch list for deposit markets: needs a five-digit county and a bank id, coordinates may be missing."""
    raw = read_named_csv(spark, list(paths), BRANCH_COLUMNS, FILE_YEAR)
    county = pad_left(F.coalesce(F.trim("county"), F.lit("")), 5)
    return raw.select(
        county.alias("county_fips"), F.trim("cert").alias("bank_id"), money("deposits").alias("deposits"), "year"
    ).where(F.col("county_fips").rlike("^[0-9]{5}$") & (F.col("bank_id") != ""))


def read_header_json(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON array-of-arrays whose first row is the header, as one map per data row.

    Each file is one small document (a state of one survey vintage), so whole-text reading is bounded.
    """
    return parse_header_json(spark.read.text(list(paths), wholetext=True).select(
        "value", F.regexp_extract(F.col("_metadata.file_path"), r"acs5_([0-9]{4})", 1).try_cast("int").alias("vintage")))


def parse_header_json(documents: DataFrame) -> DataFrame:
    """(value, vintage) documents to (vintage, record map)."""
    rows = documents.select("vintage", F.from_json("value", "array<array<string>>").alias("rows")).where("size(rows) > 1")
    body = rows.select("vintage", F.col("rows")[0].alias("header"), F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row"))
    return body.select("vintage", F.map_from_arrays("header", "row").alias("record"))


# Survey variable codes.
SURVEY_VARIABLES = {
    "population": "B01003_001E", "median_hh_income": "B19013_001E", "poverty_universe": "B17001_001E",
    "below_poverty": "B17001_002E", "race_universe": "B02001_001E", "n_white": "B02001_002E", "n_black": "B02001_003E",
    "n_hispanic": "B03003_003E", "housing_units": "B25001_001E", "n_vacant": "B25002_003E", "labor_force": "B23025_002E",
    "n_unemployed": "B23025_005E", "n_bachelors": "B15003_022E", "n_masters": "B15003_023E",
    "n_professional": "B15003_024E", "n_doctorate": "B15003_025E", "edu_universe": "B15003_001E",
}


def survey_estimates(records: DataFrame) -> DataFrame:
    """Record maps to typed counts per tract and vintage, annotations as NULL."""
    def part(name: str, width: int) -> Column:
        return pad_left(F.coalesce(F.try_element_at("record", F.lit(name)), F.lit("")), width)

    tract = F.concat(part("state", 2), part("county", 3), part("tract", 6))
    counts = [census_number(F.try_element_at("record", F.lit(code))).alias(n) for n, code in SURVEY_VARIABLES.items()]
    return records.select(tract.alias("tract_fips"), "vintage", *counts).where(F.col("tract_fips").rlike("^[0-9]{11}$"))


LOAN_COLUMNS = {
    "borrstate": "state", "borrzip": "zip", "approvaldate": "approval", "asofdate": "as_of", "grossapproval": "gross",
    "sbaguaranteedapproval": "guaranteed", "bankname": "bank", "cdc_name": "cdc",
}


def read_loans(spark: SparkSession, seven_a: str, five_o_four: str, first_year: int = 2009, last_year: int = 2024) -> DataFrame:
    """Both loan file families as one table; the program comes from the family, the lender from either name column."""
    def family(path: str, program: str) -> DataFrame:
        return read_named_csv(spark, path, LOAN_COLUMNS).withColumn("program", F.lit(program))

    both = family(seven_a, "7a").unionByName(family(five_o_four, "504"), allowMissingColumns=True)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    zip5 = pad_left(F.substring(F.trim("zip"), 1, 5), 5)
    return both.select(
        F.upper(F.trim("state")).alias("state"), zip5.alias("zip5"),
        year_of_date(F.coalesce(blank("approval"), blank("as_of"))).alias("year"), "program",
        F.coalesce(blank("bank"), blank("cdc"), F.lit("")).alias("lender"), money("gross").alias("gross"),
        money("guaranteed").alias("guaranteed"),
    ).where((F.length("state") == 2) & F.col("zip5").rlike("^[0-9]{5}$") & F.col("year").between(first_year, last_year))


APPLICATION_SCHEMA = "tract_fips string, n_applications long, n_originated long, n_denied long, approval_rate double"


def read_state_aggregates(spark: SparkSession, path: str, schema: str = APPLICATION_SCHEMA) -> DataFrame:
    """Per-state CSVs under ``tract_aggregates_<year>`` directories as one table with the year from the directory."""
    columns = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    text = read_named_csv(spark, path, {c: c for c in columns}, r"tract_aggregates_([0-9]{4})/")
    return text.select(*[F.col(c).try_cast(t).alias(c) for c, t in columns.items()], "year")


def _positional(spark: SparkSession, path: str, sep: str, width: int, skip_header: bool) -> DataFrame:
    """Delimited lines split to an array, lines with fewer than ``width`` fields dropped."""
    lines = spark.read.text(path)
    fields = F.split(F.trim("value"), re.escape(sep))
    split = lines.select(fields.alias("f")).where(F.size("f") >= width)
    # the header is recognised by its own content: no data row has letters in the geographic id
    return split.where(~F.upper(F.array_join("f", "|")).contains("GEOID")) if skip_header else split


def parse_old_crosswalk(fields: DataFrame) -> DataFrame:
    """Comma-separated relationship rows: source id, target id and population percentage by position."""
    src, dst = (pad_left(F.trim(F.col("f")[i]), 11) for i in (3, 12))
    weight = F.trim(F.col("f")[25]).try_cast("double") / 100.0
    return fields.select(src.alias("src"), dst.alias("dst"), weight.alias("weight")).where(
        F.col("src").rlike("^[0-9]{11}$") & F.col("dst").rlike("^[0-9]{11}$") & (F.col("weight") > 0)
    )


def parse_new_crosswalk(fields: DataFrame) -> DataFrame:
    """Pipe-separated relationship rows: target, source, total and part land area by position."""
    dst, src = pad_left(F.trim(F.col("f")[1]), 11), pad_left(F.trim(F.col("f")[8]), 11)
    total, part = (F.trim(F.col("f")[i]).try_cast("double") for i in (10, 14))
    return fields.select(src.alias("src"), dst.alias("dst"), F.when(total > 0, part / total).alias("weight")).where(
        F.col("src").rlike("^[0-9]+$") & F.col("dst").rlike("^[0-9]+$") & (F.col("weight") > 0)
    )


def read_old_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return parse_old_crosswalk(_positional(spark, path, ",", 27, skip_header=False))


def read_new_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return parse_new_crosswalk(_positional(spark, path, "|", 16, skip_header=True))


def parse_zip_areas(fields: DataFrame) -> DataFrame:
    """(zip area, tract, land overlap, weight within the zip area) from pipe-separated rows."""
    area, tract = F.trim(F.col("f")[1]), pad_left(F.trim(F.col("f")[9]), 11)
    rows = fields.select(area.alias("area"), tract.alias("tract_fips"), F.trim(F.col("f")[15]).try_cast("long").alias("overlap"))
    usable = rows.where((F.col("area") != "") & F.col("tract_fips").rlike("^[0-9]{11}$") & (F.col("overlap") > 0))
    return group_share(usable, ["area"], "overlap", "weight")


def read_zip_areas(spark: SparkSession, path: str) -> DataFrame:
    return parse_zip_areas(_positional(spark, path, "|", 16, skip_header=True))


def read_county_names(spark: SparkSession, path: str) -> DataFrame:
    """County code to ``name, state`` labels."""
    fields = _positional(spark, path, "|", 5, skip_header=False).where(F.trim(F.col("f")[1]).rlike("^[0-9]+$"))
    code = pad_left(F.concat(F.trim(F.col("f")[1]), F.trim(F.col("f")[2])), 5)
    label = F.concat(F.trim(F.col("f")[4]), F.lit(", "), F.trim(F.col("f")[0]))
    return fields.select(code.alias("county_fips"), label.alias("label"))


def read_tract_centroids(spark: SparkSession, path: str) -> DataFrame:
    raw = read_named_csv(spark, path, {"GEOID": "id", "INTPTLAT": "lat", "INTPTLONG": "lon"}, sep="\t")
    return raw.select(
        pad_left(F.trim("id"), 11).alias("tract_fips"), F.trim("lat").try_cast("double").alias("lat"),
        F.trim("lon").try_cast("double").alias("lon"),
    ).dropna()


# Place suffixes dropped for display.
PLACE_SUFFIX = r"\s+(city|town|village|borough|municipality|CDP)$"


def places_index(places: DataFrame, populations: DataFrame, minimum: int = 10000) -> DataFrame:
    """Named places of active class codes with enough people, suffix dropped, largest first."""
    named = places.where(F.col("class_code").rlike("^C|^U")).join(populations, "place_id")
    return named.where(F.col("population") >= minimum).select(
        "place_id", F.regexp_replace("name", PLACE_SUFFIX, "").alias("name"), "state", "population", "lat", "lon"
    ).orderBy(F.desc("population"), "place_id")
