"""Key and collision checks used before joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).count().where("count > 1")


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Return ``df`` unchanged after checking that ``keys`` identify its rows; raise otherwise.

    Runs one small job: only whether any duplicate exists comes back to the driver.
    """
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{what}: {keys} does not identify rows; a join on it would multiply them")
    return df


def guarded_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Lazy form of ``require_unique``: the job itself fails on a duplicated key, no extra action is run.

    Collapses to one row per key with map-side combine, so it costs the shuffle the following join needs anyway.
    """
    values = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in values])
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{what}: duplicate key {keys}")).cast("bigint")).otherwise(
        F.col("__n")
    )
    return packed.where(checked == 1).drop("__n")


def left_attach(spine: DataFrame, other: DataFrame, keys: list[str], what: str, unique: bool = False) -> DataFrame:
    """Left equi-join of ``other`` onto ``spine``; columns the spine already has win, right keys must be unique."""
    fresh = [c for c in other.columns if c in keys or c not in spine.columns]
    right = other.select(*fresh)
    return spine.join(right if unique else guarded_unique(right, keys, what), keys, "left")
