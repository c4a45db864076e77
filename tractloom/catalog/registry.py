"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.domain import Domain
from .oracle import with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Domain``; ``sql`` may use the domain views of ``oracle``."""

    def register(fn: Callable[[Domain], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def build(spark: SparkSession, directory: str) -> DataFrame:
            return fn(Domain(spark, directory))

        REGISTRY[name] = Query(name, build, with_views(sql) if sql else None)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column for comparison; ``special`` sets other digits per column."""
    def one(name: str, kind: str) -> Column:
        if kind != "double":
            return F.col(name)
        # adding 0.0 turns a negative zero into zero
        return (F.round(name, special.get(name, digits)) + F.lit(0.0)).alias(name)

    return df.select(*[one(n, t) for n, t in df.dtypes])
