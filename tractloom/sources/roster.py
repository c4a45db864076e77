"""Institution rosters: ragged sheets, header aliases, listing pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import slug, strip_decimal

# Header spellings per column, and the number of lines that may precede a sheet's header.
ALIASES = {
    "name": {"organization name", "name", "institution name"},
    "address": {"address", "street address", "street"},
    "city": {"city"},
    "state": {"state", "st", "stalp"},
    "zip": {"zip", "zip code", "zipcode"},
    "type": {"cdfi type", "organization type", "type"},
    "certification_date": {"certification date", "cert date", "certification_date"},
}
HEADER_LINES = 15


def standard_columns(df: DataFrame) -> DataFrame:
    """Rename known header spellings; the first match of each name wins and unknown columns are dropped."""
    chosen: dict[str, str] = {}
    for c in df.columns:
        header = c.strip().lower()
        target = next((t for t, names in ALIASES.items() if header in names), "rssd" if "rssd" in header else None)
        if target and target not in chosen:
            chosen[target] = c
    order = [*ALIASES, "rssd"]
    return df.select(*[F.col(f"`{chosen[t]}`").alias(t) for t in order if t in chosen])


def roster_keys(df: DataFrame, name: str = "name", city: str = "city", state: str = "state") -> DataFrame:
    """Stable slug id and snapshot date; spreadsheet-style ids lose their ``.0``."""
    out = df.withColumn("roster_id", slug(F.concat_ws("_", name, city, state))).withColumn("snapshot_date", F.current_date())
    return out.withColumn("rssd", strip_decimal("rssd")) if "rssd" in df.columns else out


def ragged_sheet(rows: DataFrame, sheet: list[str], line: str, cells: str, marker: str = "certificate") -> DataFrame:
    """Data rows of sheets whose header row floats within the first lines.

    ``rows`` has sheet key columns, a line number and an array of cells. The header is the first of the leading lines
    whose first cell contains ``marker``; below it, rows with a numeric first cell are kept, one per id.
    """
    first = F.lower(F.trim(F.col(cells)[0]))
    header = rows.where((F.col(line) < HEADER_LINES) & first.contains(marker)).groupBy(*sheet).agg(F.min(line).alias("__h"))
    body = rows.join(header, sheet).where(F.col(line) > F.col("__h"))
    ident = strip_decimal(F.col(cells)[0])
    return (
        body.select(*sheet, ident.alias("id"), line, cells)
        .where(F.col("id").rlike("^[0-9]+$"))
        .groupBy(*sheet, "id")
        .agg(F.min_by(cells, line).alias(cells))
    )


#: A comma with an even number of quotes after it on its line.
OUTSIDE_QUOTES = ',(?=[^"]*+(?:"[^"]*+"[^"]*+)*+$)'


def read_sheet_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV exports of sheets as (file, line, cells). One file is one sheet of a few thousand rows."""
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    cells = F.transform(F.split("text", OUTSIDE_QUOTES), lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))
    return lines.select("file", "line", cells.alias("cells"))


def _inner(html: Column, css_class: str) -> Column:
    """Text of the first element carrying a class, tags removed."""
    raw = F.regexp_extract(html, rf'(?s)class="[^"]*\b{re.escape(css_class)}\b[^"]*"[^>]*>(.*?)</', 1)
    return F.trim(F.regexp_replace(raw, r"<[^>]*>", ""))


def parse_listing(pages: DataFrame, html: str = "html") -> DataFrame:
    """Contact cards of listing pages, one record per (name, city, state).

    A card runs from its marker class to the next card or the end of the page.
    """
    cards = F.regexp_extract_all(html, F.lit(r'(?s)(class="[^"]*sba-card-styled-listing.*?)(?=class="[^"]*sba-card-styled-listing|$)'), 1)
    one = pages.select(F.explode(cards).alias("card"))
    fields = {
        "name": "views-field-title", "address": "address-line1", "city": "locality", "state": "administrative-area",
        "zip": "postal-code", "states_served": "views-field-field-contact-states-served",
    }
    records = one.select(*[_inner(F.col("card"), css).alias(n) for n, css in fields.items()])
    return records.dropDuplicates(["name", "city", "state"])


def html_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Repeated elements of a page zipped to records: target and text of every list link, in page order."""
    item = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    zipped = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(item), 1).alias("href"), F.regexp_extract_all(html, F.lit(item), 2).alias("text")
    )
    return pages.select(key, F.explode(zipped).alias("l")).select(key, F.col("l.href").alias("href"), F.trim("l.text").alias("text"))
