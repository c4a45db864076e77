"""Parsing and normalising of identifiers, numbers, dates and addresses.

ANSI mode is on in Spark 4, so every cast of untrusted text goes through ``try_cast`` or a regex guard.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col


def pad_left(value: Column | str, width: int) -> Column:
    """Zero-pad to ``width`` without ever truncating a longer string (unlike ``lpad``)."""
    v = col(value)
    return F.when(F.length(v) >= width, v).otherwise(F.lpad(v, width, "0"))


def lender_key(agency: Column | str, respondent: Column | str) -> Column:
    return F.concat_ws("_", F.trim(col(agency)), F.trim(col(respondent)))


def county_key(state: Column | str, county: Column | str) -> Column:
    return F.concat(col(state), col(county))


def tract_key(state: Column | str, county: Column | str, tract: Column | str) -> Column:
    return F.concat(col(state), col(county), col(tract))


def state_of(fips: Column | str) -> Column:
    return F.substring(col(fips), 1, 2)


def county_of(fips: Column | str) -> Column:
    return F.substring(col(fips), 1, 5)


def normalize_tract(raw: Column | str) -> Column:
    """Six-digit tract code from ``'12.03'``-style text; NULL for blanks, ``NA`` and anything else."""
    stripped = F.translate(F.trim(col(raw)), ". ", "")  # no pattern: the expression is repeated below, once per use
    padded = pad_left(stripped, 6)
    usable = (stripped != "") & (F.upper(stripped) != "NA") & padded.rlike(r"^[0-9]{6}$")
    return F.when(usable, padded)


def to_int(raw: Column | str) -> Column:
    """Whole number from text; anything that is not an optionally signed digit run becomes 0."""
    text = F.trim(col(raw))
    return F.when(text.rlike(r"^-*[0-9]+$"), F.coalesce(text.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0))


def to_float(raw: Column | str) -> Column:
    """Double from text; blanks and unparseable text become 0.0."""
    return F.coalesce(F.trim(col(raw)).try_cast("double"), F.lit(0.0))


def census_number(raw: Column | str) -> Column:
    """Survey estimate as a double; the agency's ``-66666...`` annotations are missing values."""
    text = col(raw)
    return F.when(~text.startswith("-66666"), text.try_cast("double"))


def year_of_date(raw: Column | str) -> Column:
    """Year from ``YYYY-MM-DD`` or ``MM/DD/YYYY`` text, else NULL."""
    text = F.trim(col(raw))
    iso = F.when(text.contains("-"), F.split_part(text, F.lit("-"), F.lit(1)).try_cast("int"))
    us = F.when(~text.contains("-") & text.rlike(r"^[^/]*/[^/]*/[^/]{4}$"),
                F.split_part(text, F.lit("/"), F.lit(3)).try_cast("int"))
    return F.coalesce(iso, us)


def money(raw: Column | str) -> Column:
    """Dollar text such as ``'$1,234.50'`` to double; blanks and bad text become 0.0."""
    return F.coalesce(F.regexp_replace(F.trim(col(raw)), r"[,$]", "").try_cast("double"), F.lit(0.0))


def slug(raw: Column | str) -> Column:
    """Upper-case identifier with every non-word run replaced by one underscore."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.trim(col(raw)), r"[^\p{L}\p{N}_]+", "_")), r"^_+|_+$", "")


def strip_decimal(raw: Column | str) -> Column:
    """Drop the ``.0`` that a spreadsheet export appends to whole-number ids."""
    return F.regexp_replace(F.trim(col(raw)), r"\.0$", "")


def address_line(*parts: Column | str) -> Column:
    """Upper-case single-line address; blank parts are skipped."""
    cleaned = [F.nullif(F.trim(col(p)), F.lit("")) for p in parts]
    return F.upper(F.concat_ws(", ", *cleaned))


def address_key(*parts: Column | str) -> Column:
    """Stable lookup key of an address: SHA-1 of its normalised line."""
    return F.sha1(address_line(*parts).cast("binary"))


def is_html_stub(raw: Column | str) -> Column:
    """True when a download is an HTML page instead of data (first 64 characters start with ``<``)."""
    return F.substring(col(raw), 1, 64).rlike(r"^\s*<")
