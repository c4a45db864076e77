"""Serving documents: one nested record per state, county or place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import serving
from ..session import stored
from .domain import Domain


def state_documents(d: Domain, k: int = 5) -> DataFrame:
    """Per state: counts, mean risk per model and the riskiest tracts and counties, as one nested record."""
    risks = stored(d.risks(), "risks")
    county = serving.county_rollup(risks, ["state_fips", "county_fips", "model"], ["risk"])
    means = risks.groupBy("state_fips", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk")
    ).where("n >= 5")
    top = serving.top_places(risks, ["state_fips"], "model", "risk", "tract_fips", k)
    top_counties = serving.top_places(county, ["state_fips"], "model", "risk", "county_fips", k).withColumnRenamed("top", "top_counties")
    per_model = means.join(top, ["state_fips", "model"], "left").join(top_counties, ["state_fips", "model"], "left")
    # a handful of model keys per state: the list is bounded by the number of models
    entry = F.struct("model", F.round("mean_risk", 4).alias("mean_risk"), "top", "top_counties")
    return per_model.groupBy("state_fips").agg(F.max("n").alias("n_tracts"), F.sort_array(F.collect_list(entry)).alias("models"))


def county_documents(d: Domain, k: int = 8) -> DataFrame:
    """Per county: top drivers per model as one nested record."""
    tracts = stored(d.risks().select("tract_fips", "model", "county_fips", "risk", "population"), "risks")
    attributions = stored(d.drivers().drop("county_fips", "state_fips"), "drivers")
    drivers = serving.county_drivers(attributions, tracts, "county_fips", "tract_fips", k)
    entry = F.struct("model", "rank", "feature", F.round("value", 4).alias("value"), F.round("points", 3).alias("points"))
    return drivers.groupBy("county_fips").agg(F.sort_array(F.collect_list(entry)).alias("drivers"))
