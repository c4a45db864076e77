"""Fixed-width disclosure and transmittal files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import county_key, lender_key, normalize_tract, to_float, to_int

# Zero-based [start, end) positions of the fields.
PRESENCE_FIELDS = {
    "respondent": (5, 15), "agency": (15, 16), "state": (20, 22), "county": (22, 25), "tract": (30, 37), "indicator": (47, 48),
}
TOTALS_FIELDS = {
    "respondent": (5, 15), "agency": (15, 16), "state": (22, 24), "county": (24, 27), "level": (42, 45),
    "count_lt_100": (45, 55), "amount_lt_100": (55, 65), "count_100_250": (65, 75), "amount_100_250": (75, 85),
    "count_250_1m": (85, 95), "amount_250_1m": (95, 105),
}
TRANSMITTAL_FIELDS = {
    "respondent": (0, 10), "agency": (10, 11), "year": (11, 15), "name": (15, 45), "street": (45, 85), "city": (85, 110),
    "state": (110, 112), "zip": (112, 122),
}
# Minimum line lengths and the report level kept.
PRESENCE_LENGTH, TOTALS_LENGTH, TRANSMITTAL_LENGTH, COUNTY_LEVEL = 48, 145, 122, 40


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Latin-1 text lines as (line, year). The year is the last four-digit directory name of the path.

    Read as a one-column CSV with an unused separator, because the text source does not decode Latin-1. Lines keep
    their trailing blanks: field positions and minimum lengths depend on them.
    """
    lines = (
        spark.read.schema("line string")
        .options(sep="\x01", quote="", escape="", encoding="ISO-8859-1", ignoreLeadingWhiteSpace="false",
                 ignoreTrailingWhiteSpace="false", header="false", mode="PERMISSIVE")
        .csv(list(paths))
    )
    return lines.select("line", year_of_path(F.col("_metadata.file_path")).alias("year")).where("line is not null")


def year_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"/([0-9]{4})/(?!.*/[0-9]{4}/)", 1).try_cast("int")


def _fields(slices: dict[str, tuple[int, int]]) -> dict[str, Column]:
    return {n: F.trim(F.substring("line", a + 1, b - a)) for n, (a, b) in slices.items()}


def parse_presence(lines: DataFrame) -> DataFrame:
    """(tract_fips, county_fips, lender_id, year) of every tract where a lender reports activity, distinct."""
    f = _fields(PRESENCE_FIELDS)
    kept = lines.where(F.col("line").startswith("D6-0") & (F.length("line") >= PRESENCE_LENGTH))
    parsed = kept.select(
        county_key(f["state"], f["county"]).alias("county_fips"),
        lender_key(f["agency"], f["respondent"]).alias("lender_id"),
        normalize_tract(f["tract"]).alias("tract"),
        "year",
        ((f["state"] != "") & (f["county"] != "") & (F.upper(f["indicator"]) == "Y")).alias("usable"),
    )
    usable = parsed.where(F.col("usable") & F.col("tract").isNotNull())
    return usable.select(F.concat("county_fips", "tract").alias("tract_fips"), "county_fips", "lender_id", "year").distinct()


def parse_totals(lines: DataFrame) -> DataFrame:
    """County-level size-bucket totals per lender and year."""
    f = _fields(TOTALS_FIELDS)
    kept = lines.where(F.col("line").rlike("^D1-[12]") & (F.length("line") >= TOTALS_LENGTH))
    measures = {n: (to_int if n.startswith("count") else to_float)(f[n]) for n in TOTALS_FIELDS if n[:5] in ("count", "amoun") and n != "county"}
    rows = kept.where((f["state"] != "") & (f["county"] != "") & (to_int(f["level"]) == COUNTY_LEVEL)).select(
        county_key(f["state"], f["county"]).alias("county_fips"), lender_key(f["agency"], f["respondent"]).alias("lender_id"),
        "year", *[e.alias(n) for n, e in measures.items()],
    )
    return rows.groupBy("county_fips", "lender_id", "year").agg(*[F.sum(n).alias(n) for n in measures])


def parse_transmittal(lines: DataFrame) -> DataFrame:
    """One row per reporter: id, name and address."""
    f = _fields(TRANSMITTAL_FIELDS)
    kept = lines.where(F.length("line") >= TRANSMITTAL_LENGTH)
    return kept.select(
        lender_key(f["agency"], f["respondent"]).alias("lender_id"), f["agency"].alias("agency_code"),
        F.coalesce(f["year"].try_cast("int"), F.col("year")).alias("activity_year"), f["name"].alias("name"),
        f["street"].alias("street"), f["city"].alias("city"), f["state"].alias("state"), f["zip"].alias("zip"),
    )


def discover(spark: SparkSession, root: str, kind: str, years: list[int] | None = None) -> DataFrame:
    """Data files of one kind under ``root/<year>/<kind>/`` as (path, year); other extensions are ignored."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", year_of_path(F.col("path")).alias("year"))
        .where(F.lower("path").rlike(rf"/{kind}/[^/]*\.(dat|txt)$") & F.col("year").isNotNull())
    )
    return files.where(F.col("year").isin(years)) if years else files
