"""Schema-drift audit of yearly files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def headers(spark: SparkSession, *paths: str, sep: str = ",") -> DataFrame:
    """(source, year, columns, n_rows) of delimited files: the first line of each file is its header."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"), "value",
    )
    return summarize_headers(lines.withColumn("first", F.struct("at", "n")), sep)


def summarize_headers(lines: DataFrame, sep: str = ",") -> DataFrame:
    """Header and row count per file from (file, first, value) lines, ``first`` ordering the lines of a file."""
    per = lines.groupBy("file").agg(F.min_by("value", "first").alias("header"), (F.count(F.lit(1)) - 1).alias("n_rows"))
    year = F.regexp_extract("file", r"([0-9]{4})(?!.*[0-9]{4})", 1).try_cast("int")
    source = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"[0-9]{4}|\.[^.]*$", "")
    # A separator counts if an even number of quotes follows it: the others stand inside a quoted name.
    names = F.split(F.regexp_replace("header", "^﻿", ""), re.escape(sep) + '(?=(?:[^"]*"[^"]*")*[^"]*$)')
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), '""', '"')
    columns = F.transform(names, lambda c: F.lower(F.trim(bare(c))))
    return per.select(F.rtrim(F.regexp_replace(source, "[_-]+$", "")).alias("source"), year.alias("year"), columns.alias("columns"), "n_rows")


def schema_drift(tables: DataFrame) -> DataFrame:
    """Columns added and removed against the source's latest year. Input: (source, year, columns, n_rows)."""
    anchor = tables.groupBy("source").agg(F.max_by("columns", "year").alias("anchor"), F.max("year").alias("anchor_year"))
    return tables.join(anchor, "source").select(
        "source", "year", "anchor_year", "n_rows", F.size("columns").alias("n_columns"),
        F.sort_array(F.array_except("columns", "anchor")).alias("added"),
        F.sort_array(F.array_except("anchor", "columns")).alias("removed"),
    )


def record_profile(lines: DataFrame, by: list[str], line: str = "line", prefix: int = 4) -> DataFrame:
    """Count, shortest and longest line per record type of fixed-width files."""
    return lines.groupBy(*by, F.trim(F.substring(line, 1, prefix)).alias("record_type")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.length(line)).alias("min_length"), F.max(F.length(line)).alias("max_length")
    )
