"""The whole feature build as one plan: fact -> features -> merged panel -> labels -> residuals.

The fact is stored once, dealt by tract: its features are grouped and merged where it lies. The merged panel is stored once;
labels and residuals read it and are joined back on its key, so no merge step has to run twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohorts, concentration, rollups, spatial, temporal
from ..operators.checks import left_attach
from ..session import joined_in_parts, stored, stored_by
from ..sources.programs import program_panel
from .domain import Domain

RESIDUAL_TARGETS = ["top1_lender_share_tract", "lender_hhi_tract", "pct_loans_under_100k"]


def merged_features(d: Domain) -> DataFrame:
    """All feature families on the (tract, year) spine; every right side has one row per join key."""
    keys, parts = ["tract_fips", "year"], d.parts()
    fact = stored_by(d.fact().select(*keys, "lender_id", "n_loans", "count_lt_100", "count_100_250"), "fact", "tract_fips", parts)
    places = d.places()
    branches = stored(d.branches().select("branch_id", "bank_id", "county_fips", "deposits", "year", "lat", "lon"), "branches")

    churn = concentration.entity_churn(fact)
    shares = concentration.concentration(fact)
    market = rollups.branch_market(branches)
    market = temporal.calendar_change(market, "county_fips", "year", ["branch_count", "deposit_hhi"])
    near = spatial.count_within(places, branches, 5.0, by=["year"], output="branches_within_5mi")
    first, last = (fact.agg(f("year")).scalar() for f in (F.min, F.max))
    programs = program_panel(places, first, last, first - 2009)

    panel = churn
    panel = left_attach(panel, places.drop("lat", "lon"), ["tract_fips"], "places", unique=True)
    panel = left_attach(panel, shares, keys, "concentration", unique=True)
    # a row per county or state and year: a join that deals the panel by these would pile it up in a few tasks
    panel = left_attach(panel, F.broadcast(market), ["county_fips", "year"], "branch market", unique=True)
    panel = left_attach(panel, near.repartition(parts, "tract_fips"), keys, "branch proximity", unique=True)
    panel = left_attach(panel, F.broadcast(programs), ["state_fips", "year"], "programs", unique=True)
    return temporal.asof_vintage(panel, d.demographics().repartition(parts, "tract_fips"))


def build_panel(d: Domain, horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Merged features with peer-relative labels, forward labels and residualised concentration."""
    features = merged_features(d)
    with joined_in_parts(d.spark):
        panel = stored(features, "panel")
    cohort = ["year", "is_rural"]
    keys = ["tract_fips", "year"]
    labelled = cohorts.service_desert(panel.select(*keys, "is_rural", "n_lenders"), cohort)
    labels = temporal.forward_labels(
        labelled.select(*keys, "is_service_desert", "service_desert_score"), "tract_fips", "year", ["is_service_desert"], list(horizons)
    )
    residuals = cohorts.residualize(panel.select(*keys, "is_rural", "n_lenders", *RESIDUAL_TARGETS), cohort, RESIDUAL_TARGETS, "n_lenders")
    residuals = residuals.select(*keys, *[f"{t}_resid" for t in RESIDUAL_TARGETS])
    return left_attach(left_attach(panel, labels, keys, "labels", unique=True), residuals, keys, "residuals", unique=True)
