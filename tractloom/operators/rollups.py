"""Source-level roll-ups: disclosure totals, loans, applications, investments, demographics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import ratio

BUCKETS = ["count_lt_100", "amount_lt_100", "count_100_250", "amount_100_250", "count_250_1m", "amount_250_1m"]


def bucket_totals(rows: DataFrame, keys: list[str], measures: list[str] = BUCKETS) -> DataFrame:
    """Size-bucket totals per county, lender and year."""
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def apportion(
    presence: DataFrame, totals: DataFrame, county: str = "county_fips", lender: str = "lender_id", year: str = "year",
    place: str = "tract_fips", digits: tuple[int, int] = (4, 2),
) -> DataFrame:
    """Spread each county-lender total equally over the distinct tracts where the lender is present.

    A lender present without totals gets zeros. ``digits`` rounds counts and amounts. Counting tracts is an aggregate joined back, not a window, so one
    lender-county never sits in one task.
    """
    keys = [county, lender, year]
    where = presence.select(*keys, place).distinct()
    sizes = where.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    per_tract = sizes.join(totals, keys, "left").select(
        *keys, *[(F.coalesce(F.col(m), F.lit(0)) / F.col("__n")).alias(m) for m in BUCKETS]
    )
    counts, amounts = [m for m in BUCKETS if m.startswith("count")], [m for m in BUCKETS if m.startswith("amount")]

    def total(ms: list[str]) -> Column:
        out = F.col(ms[0])
        for m in ms[1:]:
            out = out + F.col(m)
        return out

    return where.join(per_tract, keys).select(
        place, county, lender, year,
        F.round(total(counts), digits[0]).alias("n_loans"), F.round(total(amounts), digits[1]).alias("amount_k"),
        *[F.round(m, digits[0] if m in counts else digits[1]).alias(m) for m in BUCKETS],
    )


def branch_market(branches: DataFrame, county: str = "county_fips", bank: str = "bank_id", deposits: str = "deposits",
                  average_digits: int | None = 2) -> DataFrame:
    """Branches, banks, deposits and deposit concentration per county-year, rounded as published."""
    per_bank = branches.groupBy(county, "year", bank).agg(
        F.count(F.lit(1)).alias("__b"), F.sum(deposits).cast("double").alias("__d")
    )
    d, b = F.sum("__d"), F.sum("__b")
    average = F.round(d, 2) / b
    return per_bank.groupBy(county, "year").agg(
        b.alias("branch_count"),
        F.count(F.lit(1)).alias("bank_count"),
        F.round(F.round(d, 2), 0).alias("total_deposits"),
        (average if average_digits is None else F.round(average, average_digits)).alias("avg_deposits"),
        F.round(F.when(d > 0, F.sum(F.col("__d") * F.col("__d")) / (d * d)).otherwise(F.lit(0.0)), 6).alias("deposit_hhi"),
        F.round(F.when(d > 0, F.max("__d") / d).otherwise(F.lit(0.0)), 6).alias("top_bank_share"),
    )


def loan_rollup(loans: DataFrame, keys: list[str], programs: list[str]) -> DataFrame:
    """Loans by program, amounts and distinct named lenders per area and year."""
    lender = F.nullif(F.trim("lender"), F.lit(""))
    return loans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_loans"),
        *[F.count_if(F.col("program") == p).alias(f"n_{p}") for p in programs],
        F.sum("gross").alias("sum_gross"),
        F.sum("guaranteed").alias("sum_guaranteed"),
        F.count_distinct(lender).alias("n_distinct_lenders"),
    )


# Outcome codes and the category names counted separately.
OUTCOMES = {"n_originated": 1, "n_denied": 3, "n_withdrawn": 4, "n_purchased": 6}
RACES = {"n_white": "White", "n_black": "Black or African American", "n_asian": "Asian"}
HISPANIC = "Hispanic or Latino"


def application_counts(applications: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable part of the application roll-up: counts and sums only."""
    a, amount = F.col("action"), F.col("amount")
    race = F.nullif(F.trim("race"), F.lit(""))
    usable = applications.where(a.isNotNull())
    return usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_applications"),
        *[F.count_if(a == code).alias(name) for name, code in OUTCOMES.items()],
        F.coalesce(F.sum(F.when(amount > 0, amount)), F.lit(0.0)).alias("sum_amount"),
        F.count_if(amount > 0).alias("n_with_amount"),
        *[F.count_if(race == v).alias(n) for n, v in RACES.items()],
        F.count_if(race.isNotNull() & ~race.isin(list(RACES.values()))).alias("n_other_race"),
        F.count_if(F.trim("ethnicity") == HISPANIC).alias("n_hispanic"),
    )


def application_rollup(applications: DataFrame, keys: list[str], lender: str = "lender") -> DataFrame:
    """Outcomes, approval and denial rates, mean positive amount, distinct lenders and group counts per place-year."""
    counts = application_counts(applications, keys)
    lenders = (
        applications.where(F.col("action").isNotNull())
        .groupBy(*keys).agg(F.count_distinct(F.nullif(F.trim(lender), F.lit(""))).alias("n_distinct_lenders"))
    )
    decided = F.col("n_originated") + F.col("n_denied") + F.col("n_withdrawn")
    return counts.join(lenders, keys).select(
        *keys, "n_applications", *OUTCOMES,
        F.coalesce(ratio("n_originated", decided), F.lit(0.0)).alias("approval_rate"),
        F.coalesce(ratio("n_denied", decided), F.lit(0.0)).alias("denial_rate"),
        "sum_amount", F.coalesce(ratio("sum_amount", "n_with_amount"), F.lit(0.0)).alias("mean_amount"),
        "n_distinct_lenders", *RACES, "n_hispanic", "n_other_race",
    )


def investment_totals(investments: DataFrame, keys: list[str]) -> DataFrame:
    """Dollars (in thousands) and projects per area and year."""
    return investments.groupBy(*keys).agg(
        F.sum(F.col("dollars") / 1000.0).alias("dollars_k"), F.count(F.lit(1)).alias("projects")
    )


def demographic_shares(df: DataFrame) -> DataFrame:
    """Percentages (0-100, two decimals) from counts, NULL where the universe is missing or empty."""

    def pct(part: Column | str, universe: str) -> Column:
        return F.round(ratio(F.col(part) * 100.0 if isinstance(part, str) else part * 100.0, universe), 2)

    degrees = sum(
        (F.coalesce(F.col(c), F.lit(0.0)) for c in ("n_bachelors", "n_masters", "n_professional", "n_doctorate")),
        F.lit(0.0),
    )
    return df.withColumns({
        "pct_poverty": pct("below_poverty", "poverty_universe"),
        "pct_minority": F.round((F.lit(1.0) - ratio("n_white", "race_universe")) * 100.0, 2),
        "pct_black": pct("n_black", "race_universe"),
        "pct_hispanic": pct("n_hispanic", "race_universe"),
        "pct_vacant": pct("n_vacant", "housing_units"),
        "unemployment_rate": pct("n_unemployed", "labor_force"),
        "pct_bachelor_plus": F.when(degrees > 0, F.round(ratio(degrees * 100.0, "edu_universe"), 2)),
    })


def hit_rate(lookups: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Share of successful lookups per source."""
    ok = (F.col(status) == "ok").cast("double")
    return lookups.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == "ok").alias("n_ok"), F.avg(ok).alias("rate"))
