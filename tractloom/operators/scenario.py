"""What-if re-scoring: levers shift risk on the log-odds scale, no model is re-run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import logit, sigmoid, strength_word
from .serving import top_attributions

# Lever feature, its group, and whether more of it lowers (+1) or raises (-1) risk.
LEVERS = [
    ("distance_to_nearest_bank_branch", "branch_access", -1),
    ("branches_within_5mi", "branch_access", 1),
    ("mdi_branches_within_25mi", "mdi_mission_lender", 1),
    ("ssbci_active", "ssbci_state_policy", 1),
    ("microloan_intermediary_within_25mi", "microlender_ecosystem", 1),
    ("lender_hhi_tract_resid", "residualized_concentration", -1),
]
# Share of a shift that reaches the model without levers, and the baseline of the lever summary.
OTHER_MODEL_DAMPING = 0.4
SUMMARY_BASE_RISK = 0.10
SUMMARY_SHIFT = 2.0


def levers_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVERS, "feature string, lever_group string, polarity int")


def lever_strengths(levers: DataFrame, importance: DataFrame, ablation: DataFrame) -> DataFrame:
    """Log-odds shift of each lever for a +1 z move.

    The group's strength is ten times the drop in average precision when the group is removed (at most 0.42); if that
    drop is not above 0.005 it is a small share of importance instead (at most 0.04). The lever takes its share of the
    group's importance. The lever table is a fixed handful of rows, so its totals are scalar subqueries and windows.
    """
    i = F.coalesce("importance", F.lit(0.0))
    joined = levers.join(importance.select("feature", "importance"), "feature", "left").join(
        ablation.select("lever_group", "delta_ap"), "lever_group", "left"
    )
    known = joined.withColumn("__i", i)
    group = known.groupBy("lever_group").agg(F.sum("__i").alias("__g"))
    total = known.agg(F.sum("__i")).scalar()
    whole = F.when(total > 0, total).otherwise(F.lit(1.0))
    drop = F.greatest(-F.coalesce("delta_ap", F.lit(0.0)), F.lit(0.0))
    strength = F.when(drop > 0.005, F.least(F.lit(0.42), drop * 10.0)).otherwise(
        F.least(F.lit(0.04), F.col("__i") / whole * 0.16)
    )
    share = F.when(F.col("__g") > 0, F.col("__i") / F.col("__g")).otherwise(F.lit(1.0))
    effect = F.when(F.col("importance").isNotNull(), -F.col("polarity") * strength * share).otherwise(F.lit(0.0))
    return known.join(group, "lever_group").select("feature", "lever_group", "polarity", effect.alias("unit_effect"))


def lever_effects(strengths: DataFrame, moves: DataFrame) -> DataFrame:
    """Shift of each moved lever: unit effect times its z move; moves below 1e-6 do nothing."""
    return strengths.join(moves, "feature").where(F.abs("z") >= 1e-6).select(
        "feature", (F.col("unit_effect") * F.col("z")).alias("effect")
    )


def total_effect(effects: DataFrame, model: Column) -> Column:
    """Total shift for a model key; every model but the lever model receives a damped part."""
    total = F.coalesce(effects.agg(F.sum("effect")).scalar(), F.lit(0.0))
    return F.when(model.startswith("m2"), total).otherwise(total * OTHER_MODEL_DAMPING)


def apply_scenario(risks: DataFrame, effects: DataFrame, model: str = "model", risk: str = "risk") -> DataFrame:
    """Re-scored risk of every row. The total shift is one number, so this is a map over the rows."""
    return risks.withColumn("risk_after", sigmoid(logit(risk) + total_effect(effects, F.col(model))))


def adjusted_drivers(drivers: DataFrame, effects: DataFrame, keys: list[str], model: str = "model", k: int = 8) -> DataFrame:
    """Driver lists after the scenario: lever shifts are added as attributions, then the top ``k`` are taken again."""
    shift = F.explode(
        effects.agg(F.collect_list(F.struct("feature", "effect"))).scalar()
    )
    places = drivers.select(*keys).distinct()
    added = places.select(*keys, shift.alias("__s")).select(
        *keys, F.col("__s.feature").alias("feature"),
        (F.col("__s.effect") * F.when(F.col(model).startswith("m2"), 1.0).otherwise(OTHER_MODEL_DAMPING)).alias("attribution"),
    )
    merged = (
        drivers.select(*keys, "feature", "attribution").unionByName(added)
        .groupBy(*keys, "feature").agg(F.sum("attribution").alias("attribution"))
    )
    rounded = merged.withColumn("attribution", F.round("attribution", 9))
    return top_attributions(rounded, keys, k)


def crossings(risks: DataFrame, by: list[str], threshold: float, before: str = "risk", after: str = "risk_after") -> DataFrame:
    """How many places a scenario moves across a risk threshold, in each direction."""
    b, a = F.col(before) >= threshold, F.col(after) >= threshold
    return risks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a & ~b).alias("n_up"), F.count_if(b & ~a).alias("n_down"),
        (F.count_if(a & ~b) - F.count_if(b & ~a)).alias("net"),
    )


def lever_summary(strengths: DataFrame) -> DataFrame:
    """Effect of moving each lever to the far right on a place at the baseline risk, in points and in words."""
    start = F.lit(SUMMARY_BASE_RISK)
    delta = (sigmoid(logit(start) + F.col("unit_effect") * SUMMARY_SHIFT) - start) * 100.0
    return strengths.select(
        "feature", "lever_group", delta.alias("delta_points"),
        F.when(delta >= 0, "increases").otherwise("decreases").alias("direction"),
        strength_word(delta).alias("strength"),
    )
