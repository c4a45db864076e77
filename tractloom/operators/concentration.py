"""Lender concentration, mix and churn of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import gated, ratio
from .temporal import by_calendar_year, trailing_mean


def herfindahl(amount: Column | str) -> Column:
    """Aggregate expression: sum of squared shares, as sum(x^2) / sum(x)^2 so that no second pass is needed."""
    x = F.col(amount) if isinstance(amount, str) else amount
    total = F.sum(x)
    return F.when(total > 0, F.sum(x * x) / (total * total)).otherwise(F.lit(0.0))


def top_k_rows(df: DataFrame, by: list[str], amount: str, tie: str, k: int) -> DataFrame:
    """The ``k`` largest rows per group. The rank filter is pushed below the shuffle as a group limit."""
    order = Window.partitionBy(*by).orderBy(F.col(amount).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_shares(df: DataFrame, by: list[str], amount: str, tie: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of the ``k`` largest contributors in the group total, one ``top{k}_share`` column per k."""
    best = top_k_rows(df, by, amount, tie, max(ks)).groupBy(*by).agg(
        *[F.sum(F.when(F.col("rank") <= k, F.col(amount))).alias(f"__t{k}") for k in ks]
    )
    total = df.groupBy(*by).agg(F.sum(amount).alias("__total"))
    shares = [
        F.when(F.col("__total") > 0, F.col(f"__t{k}") / F.col("__total")).otherwise(F.lit(0.0)).alias(f"top{k}_share")
        for k in ks
    ]
    return total.join(best, by).select(*by, *shares)


def place_totals(fact: DataFrame, keys: list[str], lender: str = "lender_id") -> DataFrame:
    """Loan totals by size bucket and number of distinct lenders per place and year."""
    return fact.groupBy(*keys).agg(
        F.sum("n_loans").cast("double").alias("total_loans"),
        F.sum("count_lt_100").cast("double").alias("n_under_100"),
        F.sum("count_100_250").cast("double").alias("n_100_250"),
        F.count_distinct(lender).alias("n_active_lenders"),
    )


CONCENTRATION_COLUMNS = [
    "top1_lender_share_tract", "top3_lender_share_tract", "lender_hhi_tract",
    "pct_loans_under_100k", "pct_loans_under_250k",
]


def concentration(
    fact: DataFrame, place: str = "tract_fips", year: str = "year", lender: str = "lender_id", gate: int = 3,
    lags: tuple[int, int] | None = (2, 5),
) -> DataFrame:
    """Lender concentration of each place and year, with trailing means over earlier rows of the same place.

    Everything but the top-3 share is algebraic and comes from one aggregation; concentration measures are hidden
    below ``gate`` lenders, loan-size shares are not.
    """
    keys = [place, year]
    totals = fact.groupBy(*keys).agg(
        F.sum("n_loans").cast("double").alias("__total"),
        F.sum(F.col("n_loans").cast("double") * F.col("n_loans")).alias("__squares"),
        F.max("n_loans").cast("double").alias("__top"),
        F.sum("count_lt_100").alias("__u100"),
        F.sum("count_100_250").alias("__u250"),
        F.count_distinct(lender).alias("n_active_lenders_tract"),
    )
    best = top_k_rows(fact.select(*keys, lender, "n_loans"), keys, "n_loans", lender, 3).groupBy(*keys).agg(
        F.sum("n_loans").alias("__top3")
    )
    total, support = F.col("__total"), F.col("n_active_lenders_tract")

    def share(x: Column) -> Column:
        return F.when(total > 0, x / total).otherwise(F.lit(0.0))

    out = totals.join(best, keys).select(
        *keys,
        "n_active_lenders_tract",
        gated(share(F.col("__top")), support, gate).alias("top1_lender_share_tract"),
        gated(share(F.col("__top3")), support, gate).alias("top3_lender_share_tract"),
        gated(share(F.col("__squares") / total), support, gate).alias("lender_hhi_tract"),
        ratio(F.col("__u100"), total).alias("pct_loans_under_100k"),
        ratio(F.col("__u100") + F.col("__u250"), total).alias("pct_loans_under_250k"),
    )
    return trailing_mean(out, place, year, CONCENTRATION_COLUMNS, *lags) if lags else out


def lender_mix(
    fact: DataFrame, flags: DataFrame, shares: dict[str, str], place: str = "tract_fips", year: str = "year",
    lender: str = "lender_id", gate: int = 3,
) -> DataFrame:
    """Share of loans made by flagged lenders; ``shares`` maps a flag column to its output name.

    A lender with an unknown flag adds nothing to the numerator but stays in the denominator.
    """
    joined = fact.join(flags.select(lender, year, *shares), [lender, year], "left")
    sums = [F.sum(F.col("n_loans") * F.coalesce(F.col(f), F.lit(0))).alias(f"__{f}") for f in shares]
    grouped = joined.groupBy(place, year).agg(
        F.sum("n_loans").alias("__total"), F.count_distinct(lender).alias("n_active_lenders"), *sums
    )
    return grouped.select(
        place, year, "n_active_lenders",
        *[gated(ratio(f"__{f}", "__total"), "n_active_lenders", gate).alias(name) for f, name in shares.items()],
    )


def market_structure(
    df: DataFrame, keys: list[str], entity: str, measures: dict[str, str]
) -> DataFrame:
    """Entities, total, concentration and top share per market; ``measures`` maps a column to an output stem."""
    per_entity = df.groupBy(*keys, entity).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(c).cast("double").alias(c) for c in measures]
    )
    out = []
    for c, stem in measures.items():
        total = F.sum(c)
        out += [
            total.alias(f"{stem}_total"),
            herfindahl(c).alias(f"{stem}_hhi"),
            F.when(total > 0, F.max(c) / total).otherwise(F.lit(0.0)).alias(f"{stem}_top_share"),
        ]
    return per_entity.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum("__rows").alias("n_rows"), *out
    )


def entity_churn(
    fact: DataFrame, place: str = "tract_fips", entity: str = "lender_id", year: str = "year",
    lags: tuple[int, ...] = (1, 3),
) -> DataFrame:
    """Entries, exits, churn and retention of a place's entity set against the calendar years ``year - lag``.

    A place's entity set is never built. Each (place, entity) has at most one row per calendar year, so "was also here n
    years ago" counts the one row that lies n years back; set sizes then follow from counts. entries = now - kept,
    exits = before - kept.
    """
    seen = fact.where(F.col(year).isNotNull()).select(place, entity, year).distinct()
    own = Window.partitionBy(place, entity).orderBy(year)
    kept = [F.count(F.lit(1)).over(own.rangeBetween(-lag, -lag)).alias(f"__k{lag}") for lag in lags]
    counts = (
        seen.select(place, year, *kept)
        .groupBy(place, year)
        .agg(F.count(F.lit(1)).alias("n_lenders"), *[F.sum(f"__k{lag}").alias(f"__k{lag}") for lag in lags])
    )
    history = by_calendar_year(counts, place, year, ["n_lenders"], [-lag for lag in lags])
    out = [F.col(place), F.col(year), F.col("n_lenders")]
    for lag in lags:
        before = F.coalesce(F.col(f"n_lenders_m{lag}"), F.lit(0))
        k = F.col(f"__k{lag}")
        out += [
            (F.col("n_lenders") - k).alias(f"entries_{lag}yr"),
            (before - k).alias(f"exits_{lag}yr"),
            (F.col("n_lenders") + before - 2 * k).alias(f"churn_{lag}yr"),
            ratio(k, before).alias(f"retention_{lag}yr"),
        ]
    return history.select(*out)


def always_present(fact: DataFrame, entity: str, year: str) -> DataFrame:
    """Entities that report in every year of the panel (relational division by counting)."""
    years = fact.select(year).distinct().agg(F.count(F.lit(1))).scalar()
    return (
        fact.groupBy(entity)
        .agg(F.count_distinct(year).alias("n_years"))
        .where(F.col("n_years") == years)
    )


def lender_flags(
    grid: DataFrame, assets: DataFrame, national: DataFrame, members: dict[str, DataFrame], threshold: float,
    lender: str = "lender_id", year: str = "year", top: int = 4,
) -> DataFrame:
    """Lender-year dimension: size flag (three-valued), top-``top`` by amount, and membership flags.

    ``members`` maps an output flag to a frame of lender ids; ``national`` is lender-year amounts.
    """
    best = top_k_rows(
        national.groupBy(year, lender).agg(F.sum("amount").alias("amount")), [year], "amount", lender, top
    ).select(lender, year, F.lit(1).alias("is_top4"))
    out = grid.select(lender, year).distinct().join(assets.select(lender, year, "assets"), [lender, year], "left")
    out = out.join(best, [lender, year], "left")
    for name, ids in members.items():
        out = out.join(ids.select(lender).distinct().withColumn(name, F.lit(1)), lender, "left")
    return out.select(
        lender, year, "assets",
        (F.col("assets") < F.lit(threshold)).cast("int").alias("is_community_bank"),
        F.coalesce("is_top4", F.lit(0)).alias("is_top4"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in members],
    )
