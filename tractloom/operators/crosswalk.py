"""Boundary crosswalks as long tables (src, dst, weight) and re-aggregation through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohorts import group_share


def compose(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """A->B->C with multiplied weights; a B that the second table does not know maps to itself."""
    second = bc.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("weight").alias("w2"))
    joined = ab.withColumnRenamed("dst", "mid").join(second, "mid", "left")
    return (
        joined.select(
            "src",
            F.coalesce("end", "mid").alias("dst"),
            (F.col("weight") * F.coalesce("w2", F.lit(1.0))).alias("weight"),
        )
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"))
    )


def normalize_weights(xwalk: DataFrame) -> DataFrame:
    """Scale the weights of each source to 1."""
    return (
        group_share(xwalk, ["src"], "weight", "__share")
        .select("src", "dst", F.coalesce("__share", "weight").alias("weight"))
    )


def unify(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """All of ``primary`` plus the sources only ``fallback`` knows, weights normalised per source."""
    extra = fallback.join(primary.select("src"), "src", "left_anti")
    return normalize_weights(primary.unionByName(extra))


def fan_out(df: DataFrame, xwalk: DataFrame, key: str) -> DataFrame:
    """Replace ``key`` by its targets with a ``__w`` weight; unknown keys keep themselves at weight 1."""
    targets = xwalk.select(F.col("src").alias(key), F.col("dst").alias("__dst"), F.col("weight").alias("__w"))
    return (
        df.join(targets, key, "left")
        .withColumn(key, F.coalesce("__dst", key))
        .withColumn("__w", F.coalesce("__w", F.lit(1.0)))
        .drop("__dst")
    )


def reaggregate(
    df: DataFrame, xwalk: DataFrame, key: str, by: list[str], counts: list[str], rates: list[str],
    population: str | None = None, weight_all_rows: bool = False,
) -> DataFrame:
    """Counts become sum(v * w); rates become weighted means with weight w (times population when given).

    A rate's weight counts only where the rate is known. ``weight_all_rows`` counts it always, which pulls means
    towards zero where rates are missing; it exists to reproduce older outputs.
    """
    spread = fan_out(df, xwalk, key)
    base = F.col("__w") if population is None else F.coalesce(F.col(population), F.lit(0.0)) * F.col("__w")
    aggregates = [F.sum(F.col(c) * F.col("__w")).alias(c) for c in counts]
    for r in rates:
        weight = base if weight_all_rows else F.when(F.col(r).isNotNull(), base)
        total = F.sum(weight)
        aggregates.append(F.when(total > 0, F.sum(F.col(r) * base) / total).alias(r))
    return spread.groupBy(key, *by).agg(*aggregates)


def apportion_areas(totals: DataFrame, overlaps: DataFrame, area: str, place: str, measures: list[str]) -> DataFrame:
    """Spread area totals to places by overlap share; areas without overlaps are dropped."""
    weights = group_share(overlaps, [area], "overlap", "__share")
    joined = totals.join(weights.select(area, place, "__share"), area)
    return joined.groupBy(place).agg(*[F.sum(F.col(m) * F.col("__share")).alias(m) for m in measures])


def dominant_area(overlaps: DataFrame, place: str, area: str, overlap: str = "overlap") -> DataFrame:
    """The area with the largest overlap of each place; the smallest area id wins a tie."""
    best = F.min_by(F.col(area), F.struct(-F.col(overlap), F.col(area)))
    return overlaps.groupBy(place).agg(best.alias(area), F.max(overlap).alias(overlap))
