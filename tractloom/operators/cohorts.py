"""Peer-relative measures inside cohorts such as (year, rural/urban)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import flag, per_thousand
from .orderstats import _match, quantile_columns


def peer_group(rural: str = "is_rural") -> Column:
    return F.when(F.col(rural) == 1, "rural").otherwise("urban")


def residualize(
    df: DataFrame, cohort: list[str], targets: list[str], support: str, minimum: int = 50
) -> DataFrame:
    """Residuals of each target from a per-cohort least-squares fit on [log1p(n), n] with intercept.

    The fit needs only means and centred second moments, which one aggregation yields for all targets (variance and
    covariance aggregates combine partial results without cancellation). Rows with a NULL target are left out of that
    target's fit only. Cohorts with fewer than ``minimum`` usable rows get NULL; a degenerate design (all n equal, or
    log1p and n collinear) falls back to the regressors that do vary.
    """
    n = F.greatest(F.coalesce(F.col(support).cast("double"), F.lit(0.0)), F.lit(0.0))
    work = df.withColumn("__x2", n).withColumn("__x1", F.log1p(n))
    moments = []
    for t in targets:
        y = F.col(t).cast("double")
        x1, x2 = F.when(y.isNotNull(), F.col("__x1")), F.when(y.isNotNull(), F.col("__x2"))
        moments.append(
            F.struct(
                F.count(y).alias("n"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
                F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"),
                F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
            ).alias(f"__f_{t}")
        )
    fits = work.groupBy(*cohort).agg(*moments)
    # one row per cohort: the rows stay where they are
    fitted = _match(work, F.broadcast(fits), cohort)
    out = []
    for t in targets:
        f = F.col(f"__f_{t}")
        det = f["s11"] * f["s22"] - f["s12"] * f["s12"]
        full_rank = det > F.lit(1e-10) * f["s11"] * f["s22"]
        b1 = F.when(full_rank, (f["s22"] * f["s1y"] - f["s12"] * f["s2y"]) / det).otherwise(F.lit(0.0))
        b2 = (
            F.when(full_rank, (f["s11"] * f["s2y"] - f["s12"] * f["s1y"]) / det)
            .when(f["s22"] > 0, f["s2y"] / f["s22"])
            .otherwise(F.lit(0.0))
        )
        predicted = f["my"] + b1 * (F.col("__x1") - f["m1"]) + b2 * (F.col("__x2") - f["m2"])
        out.append(F.when(f["n"] >= minimum, F.col(t) - predicted).alias(f"{t}_resid"))
    return fitted.select(*df.columns, *out)


def group_mean_deviation(df: DataFrame, by: list[str], value: str, output: str) -> DataFrame:
    """Value minus its group mean. Aggregates first and joins the small result back, so no group is gathered."""
    means = df.groupBy(*by).agg(F.avg(value).alias("__mean"))
    return _match(df, means, by).withColumn(output, F.col(value) - F.col("__mean")).drop("__mean")


def group_share(df: DataFrame, by: list[str], value: str, output: str) -> DataFrame:
    """Share of ``value`` in its group total; NULL for groups without a positive total."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("__total"))
    share = F.when(F.col("__total") > 0, F.col(value) / F.col("__total"))
    return _match(df, totals, by).withColumn(output, share).drop("__total")


def group_zscores(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Standard scores within ``by`` (sample deviation; a constant column is divided by 1)."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns]
    )
    spread = {c: F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}")) for c in columns}
    return _match(df, stats, by).select(
        *df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / spread[c]).alias(f"{c}_z") for c in columns]
    )


def service_desert(
    df: DataFrame, cohort: list[str], lenders: str = "n_lenders", probability: float = 0.10
) -> DataFrame:
    """Bottom-decile flag (at or below the cohort threshold) and distance below the cohort median."""
    cuts = quantile_columns(df, cohort, lenders, {"service_threshold": probability, "service_median": 0.5})
    # one row per cohort: the rows stay where they are
    return _match(df, F.broadcast(cuts), cohort, "left").select(
        *df.columns,
        "service_threshold",
        F.coalesce(flag(F.col(lenders) <= F.col("service_threshold")), F.lit(0)).alias("is_service_desert"),
        (F.col("service_median") - F.col(lenders)).alias("service_desert_score"),
    )


def desert_labels(
    panel: DataFrame, cohort: list[str], lenders: str, originated: str, population: str, year: str = "year",
    first_year: int = 2018,
) -> DataFrame:
    """All desert flags of a panel. Give it a stored panel: thresholds are read from it and joined back to it."""
    out = service_desert(panel, cohort, lenders)
    rate = F.when(F.col(year) >= first_year, per_thousand(F.col(originated), population))
    rated = panel.select(*cohort, rate.alias("originations_per_1k"))
    cuts = quantile_columns(rated, cohort, "originations_per_1k", {"origination_threshold": 0.10})
    flagged = _match(out.withColumn("originations_per_1k", rate), cuts, cohort, "left")
    return flagged.withColumn(
        "is_origination_desert", flag(F.col("originations_per_1k") <= F.col("origination_threshold"))
    ).withColumn("origination_desert_score", -F.col("originations_per_1k")).withColumn("is_any_desert", any_desert())


def any_desert(service: str = "is_service_desert", origination: str = "is_origination_desert") -> Column:
    return flag((F.coalesce(F.col(service), F.lit(0)) == 1) | (F.coalesce(F.col(origination), F.lit(0)) == 1))


def branch_desert(distance: Column | str, rural: str, urban_miles: float = 5.0, rural_miles: float = 15.0) -> Column:
    """Nearest branch beyond the limit for the kind of place."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return flag(d > F.when(F.col(rural) == 1, F.lit(rural_miles)).otherwise(F.lit(urban_miles)))
