"""Risk-scale and presentation functions for scored places."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import clip, col

# Probability clip of the log-odds transform.
PROBABILITY_FLOOR = 1e-4


def logit(p: Column | str) -> Column:
    q = clip(p, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
    return F.log(q / (1.0 - q))


def sigmoid(z: Column | str) -> Column:
    """Logistic function that never overflows: the exponent is always taken of a non-positive number."""
    x = col(z)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def attribution_points(risk: Column | str, attribution: Column | str) -> Column:
    """Log-odds contribution to signed percentage points: risk minus the risk without the feature."""
    p = clip(risk, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
    return (p - sigmoid(logit(p) - col(attribution))) * 100.0


def cutpoint_percentile(value: Column | str, cutpoints: Column | str) -> Column:
    """Percentile of ``value`` in an ascending array of 99 cutpoints (p1..p99), interpolated, within 1..99.

    With k cutpoints at or below the value, the value sits between cutpoints k and k+1, so its percentile is
    k plus the fraction of that gap.
    """
    v, cuts = col(value), col(cutpoints)
    n = F.size(cuts)
    k = F.size(F.filter(cuts, lambda q: q <= v))
    low = F.try_element_at(cuts, k)
    high = F.try_element_at(cuts, k + 1)
    inside = k + (v - low) / (high - low)
    return (
        F.when(v.isNull() | cuts.isNull() | (n == 0), F.lit(None).cast("double"))
        .when(v <= F.try_element_at(cuts, F.lit(1)), F.lit(1.0))
        .when(v >= F.try_element_at(cuts, F.lit(-1)), F.lit(99.0))
        .otherwise(inside)
    )


def category_percentile(value: Column | str, categories: Column | str) -> Column:
    """Cumulative share (0..100) at or below ``value`` over an array of (value, share)."""
    v, cats = col(value), col(categories)
    share = F.aggregate(
        F.filter(cats, lambda c: c["value"] <= v), F.lit(0.0), lambda acc, c: acc + c["share"]
    )
    return F.when(v.isNotNull() & cats.isNotNull(), clip(share * 100.0, 0.0, 100.0))


def category_position(value: Column | str, categories: Column | str) -> Column:
    """Position 0..100 of ``value`` between the smallest and largest category; 50 when there is only one."""
    v, cats = col(value), col(categories)
    values = F.transform(cats, lambda c: c["value"].cast("double"))
    low, high = F.array_min(values), F.array_max(values)
    bounded = F.least(F.greatest(v.cast("double"), low), high)
    return F.when(v.isNotNull(), F.when(high == low, F.lit(50.0)).otherwise((bounded - low) / (high - low) * 100.0))


# Features for which a high value is worse, and features shown without judgement.
HIGHER_IS_WORSE = [
    "cra_county_amount_hhi", "cra_county_count_hhi", "lender_hhi_tract_resid",
    "fdic_deposit_hhi", "fdic_deposit_hhi_chg1yr", "fdic_deposit_hhi_chg3yr",
    "top1_lender_share_tract_resid", "top3_lender_share_tract_resid", "pct_loans_from_top4_banks_resid",
    "cra_county_top_lender_share_count", "cra_county_top_lender_share_amount",
    "fdic_top_bank_share", "fdic_top_bank_share_chg1yr", "fdic_top_bank_share_chg3yr",
    "distance_to_nearest_bank_branch", "nearest_mdi_branch_miles", "branch_closures_3y_within_10mi",
    "unemployment_rate", "pct_vacant", "pct_poverty", "is_persistent_poverty",
    "denial_rate", "n_denied", "n_withdrawn", "ruca_code",
]
NEUTRAL = [
    "pct_minority", "pct_black", "pct_hispanic", "n_black", "n_hispanic", "n_asian", "n_white",
    "n_other_race", "mean_loan_amount",
]


def direction_of(feature: Column | str) -> Column:
    f = col(feature)
    return (
        F.when(f.isin(NEUTRAL), "neutral").when(f.isin(HIGHER_IS_WORSE), "higher_is_worse").otherwise("lower_is_worse")
    )


def direction_class(direction: Column | str, percentile: Column | str) -> Column:
    """good / bad / neutral colouring of a percentile, given which direction is worse."""
    d, p = col(direction), col(percentile)
    signed = F.when(d == "higher_is_worse", p - 50.0).when(d == "lower_is_worse", F.lit(50.0) - p)
    return F.when(signed > 0, "bad").when(signed < 0, "good").otherwise("neutral")


def divergence_label(first: Column | str, second: Column | str) -> Column:
    """How two models disagree about one place; NULL when they agree closely enough.

    Shown when the gap is at least 0.03 or one risk is at least three times the other. Elevated means >= 0.05,
    low means < 0.02.
    """
    a, b = col(first), col(second)
    far = (F.abs(a - b) >= 0.03) | ((a > 0) & (b >= a * 3)) | ((b > 0) & (a >= b * 3))
    label = (
        F.when((a >= 0.05) & (b < 0.02), "first_higher")
        .when((a < 0.02) & (b >= 0.05), "second_higher")
        .when((a >= 0.05) & (b >= 0.05), "both_elevated")
        .when((a < 0.02) & (b < 0.02), "both_low")
        .otherwise("mixed")
    )
    return F.when(a.isNotNull() & b.isNotNull() & far, label)


def signal_verdict(mean_ap: Column | str) -> Column:
    m = col(mean_ap)
    return F.when(m >= 0.10, "strong").when(m >= 0.05, "moderate").otherwise("weak")


def strength_word(delta_points: Column | str) -> Column:
    d = F.abs(col(delta_points))
    return F.when(d >= 2.0, "clear").when(d >= 0.75, "modest").otherwise("small")


# Feature groups of the family report.
FAMILY_NAMES = {
    "place_rural": ["is_rural", "ruca_code"],
    "place_persistent_pov": ["is_persistent_poverty"],
    "regime_flag": ["has_hmda"],
    "fdic_concentration": [
        "fdic_deposit_hhi", "fdic_deposit_hhi_chg1yr", "fdic_deposit_hhi_chg3yr",
        "fdic_top_bank_share", "fdic_top_bank_share_chg1yr", "fdic_top_bank_share_chg3yr",
    ],
    "hmda": [
        "n_applications", "n_originated", "n_denied", "n_withdrawn", "n_purchased",
        "approval_rate", "denial_rate", "sum_loan_amount", "mean_loan_amount", "n_distinct_lenders",
        "n_white", "n_black", "n_asian", "n_hispanic", "n_other_race",
    ],
    "acs_demographics": [
        "population", "median_hh_income", "pct_poverty", "pct_minority", "pct_black", "pct_hispanic",
        "housing_units", "pct_vacant", "unemployment_rate", "pct_bachelor_plus",
    ],
}
FAMILY_PREFIXES = {"cra_county_": "cra_county_concentration", "fdic_": "fdic_other"}


def feature_family(feature: Column | str) -> Column:
    """Family of a feature: named members first, then the prefix families, else ``other``."""
    f = col(feature)
    expr = F
    for family, members in FAMILY_NAMES.items():
        expr = expr.when(f.isin(members), family)
    for prefix, family in FAMILY_PREFIXES.items():
        expr = expr.when(f.startswith(prefix), family)
    return expr.otherwise("other")


@dataclass
class Selection:
    """Interactive selection of places. ``ranges`` maps a column to (low, high, slider maximum)."""

    state: object | None = None
    rural_only: bool = False
    poverty_only: bool = False
    ranges: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    min_risk_pct: float = 0.0

    def predicate(self, state: str, rural: str, poverty: str, risk: str) -> Column:
        """A NULL measure passes its range, and a slider at its maximum has no upper end."""
        keep = F.lit(True)
        if self.state is not None:
            keep = keep & (F.col(state) == F.lit(self.state))
        if self.rural_only:
            keep = keep & (F.coalesce(F.col(rural), F.lit(0)) == 1)
        if self.poverty_only:
            keep = keep & (F.coalesce(F.col(poverty), F.lit(0)) == 1)
        for name, (low, high, slider_max) in self.ranges.items():
            within = F.col(name) >= low
            if high < slider_max:
                within = within & (F.col(name) <= high)
            keep = keep & (F.col(name).isNull() | within)
        return keep & (F.coalesce(F.col(risk), F.lit(0.0)) * 100.0 >= self.min_risk_pct)
