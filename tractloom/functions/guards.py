"""Null-safe arithmetic shared by all operators.

Sources turn NaN into NULL once (``nan_to_null``); after that every guard below only has to think about NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    Substituting a costly expression into itself several times makes the optimizer copy it; a lambda variable is
    evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator``, NULL when the denominator is missing, zero or negative."""
    d = col(denominator)
    return F.when(d > 0, col(numerator) / d)


def per_thousand(count: Column | str, population: Column | str) -> Column:
    """Rate per 1,000 residents, NULL for empty or unknown places."""
    return ratio(col(count) * F.lit(1000.0), population)


def gated(value: Column | str, support: Column | str, minimum: int = 3) -> Column:
    """Hide ``value`` where it rests on fewer than ``minimum`` contributors."""
    return F.when(col(support) >= minimum, col(value))


def clip(value: Column | str, low: float, high: float) -> Column:
    v = col(value)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def flag(condition: Column) -> Column:
    """Boolean to 0/1, keeping NULL as NULL."""
    return condition.cast("int")


def effective_from(value: Column | str, year: Column | str, first_year: int) -> Column:
    """Zero a designation flag for the years before it took effect; a missing flag counts as 0."""
    return F.when(col(year) < first_year, F.lit(0)).otherwise(F.coalesce(col(value), F.lit(0)))


def rural_band(code: Column | str, threshold: int = 7) -> Column:
    """Rural flag from a commuting code; a missing code counts as not rural."""
    return F.coalesce(flag(col(code) >= threshold), F.lit(0))


def below_threshold(value: Column | str, threshold: float) -> Column:
    """Three-valued flag: 1 below the threshold, 0 at or above it, NULL when the value is unknown."""
    return flag(col(value) < F.lit(threshold))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (aggregates skip NULL but propagate NaN)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        *[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero-fill the listed columns that exist; the others stay nullable."""
    present = [c for c in columns if c in df.columns]
    return df.fillna(0, subset=present) if present else df
