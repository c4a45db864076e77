"""Queries that fit models (rows only) and attributions (SQL for the linear form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import learning as L
from ..operators import serving, temporal
from ..plans.domain import Domain
from ..session import fresh_path, stored
from .registry import query, rounded

FEATURES = ["n_loans", "amount_k", "n_small", "is_rural", "population"]
LABEL = "becomes_low"
FOLDS = E.shifted(E.build_folds(6), 1995 - 2009)  # folds that the years cannot fill are skipped
FULL = L.Settings()
# The studies that refit dozens of models: the same depth and rate, but at most 40 rounds a fit (see README for the times).
REFIT = L.Settings(rounds=40)
KEYS = ["tract_fips", "year"]
HORIZONS = (1, 3)
# the same fold shape, ended early enough that the labels of the longer horizon are known
HORIZON_FOLDS = {1: FOLDS, 3: E.shifted(E.build_folds(6), 1992 - 2009)}
LABELS = {h: f"becomes_low_h{h}" for h in HORIZONS}
MODELS = {"all": FEATURES, "lending": ["n_loans", "amount_k", "n_small"]}


def study_panel(d: Domain):
    """Panel with the label "at most two lenders next year, more than two now" (NULL where it is low already)."""
    p = d.panel().withColumn("is_low", (F.col("n_lenders") <= 2).cast("int"))
    ahead = temporal.forward_labels(p, "tract_fips", "year", ["is_low"], list(HORIZONS))
    names = {LABEL: F.col("becomes_is_low_h1")} | {LABELS[h]: F.col(f"becomes_is_low_h{h}") for h in HORIZONS}
    labelled = ahead.withColumns(names).drop(*[f"{kind}_is_low_h{h}" for kind in ("state", "becomes") for h in HORIZONS])
    # every round of a fit is a few jobs over these files: few tasks for small panels, bounded ones for large
    return stored(labelled.repartition(d.parts(1_000_000), "tract_fips"), "study")


_FITTED: dict[tuple, object] = {}


def _once(d: Domain, name: str, make):
    """A fit that several queries of one session report on is made once per directory; its predictions lie in the shared folder."""
    key = (d.spark.sparkContext.applicationId, d.directory, name)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def full_study(d: Domain):
    """(panel, study): the walk-forward run on all features."""
    def make():
        panel = study_panel(d)
        return panel, L.walk_forward(panel, FEATURES, LABEL, FOLDS, FULL)

    return _once(d, "study", make)


def full_model(d: Domain):
    """(panel, model, calibration): the model to deploy on all features."""
    def make():
        panel = study_panel(d)
        return panel, *L.final_model(panel, FEATURES, LABEL, 2001, 1, FULL)

    return _once(d, "model", make)


@query("p13_feature_selection", """
    SELECT year, n_lenders, n_loans, round(amount_k, 2) AS amount_k, n_small, is_rural, population FROM d_panel""")
def _(d: Domain):
    labelled = d.panel().withColumns({"peer_group": F.lit("rural"), "is_service_desert": F.lit(1), "target_any_desert_h1": F.lit(0),
                                      "cra_lender_churn_3yr": F.col("n_loans"), "fdic_bank_count_chg1yr": F.col("n_loans")})
    return rounded(labelled.select(*L.usable_features(labelled)), 2)


@query("u03_common_columns", """
    SELECT tract_fips, year, n_lenders, n_loans, n_small, county_fips, is_rural, population FROM d_panel""")
def _(d: Domain):
    early, late = d.panel().where("year < 1998").drop("amount_k"), d.panel().where("year >= 1998").drop("state_fips")
    shared = L.common_columns([early, late])
    return early.select(*shared).unionByName(late.select(*shared))


@query("m03_boosted_walk_forward")
def _(d: Domain):
    _, study = full_study(d)
    return rounded(L.study_metrics({"full": study}))


@query("m04_calibrated_walk_forward")
def _(d: Domain):
    _, study = full_study(d)
    return rounded(L.study_metrics({"full": study}, "y_prob_calibrated"))


@query("m10_group_ablation")
def _(d: Domain):
    return rounded(L.ablate(study_panel(d), FEATURES, {"volume": ["n_loans", "n_small"], "place": ["is_rural", "population"], "amount": ["amount_k"]}, LABEL, FOLDS, REFIT))


@query("m11_family_ablation")
def _(d: Domain):
    panel = study_panel(d)
    families = {"place_rural": ["is_rural"], "acs_demographics": ["population"], "lending_volume": ["n_loans", "n_small"], "lending_amount": ["amount_k"]}
    runs = [
        L.ablate(panel, FEATURES, families, LABELS[h], HORIZON_FOLDS[h], REFIT, "y_prob_calibrated").withColumn("horizon", F.lit(h)) for h in HORIZONS
    ]
    return rounded(runs[0].unionByName(runs[1]))


@query("m12_pruning_sweep")
def _(d: Domain):
    return rounded(L.prune(study_panel(d), FEATURES, [1, 2, 3, 4], LABEL, FOLDS, REFIT))


@query("m13_regime_split")
def _(d: Domain):
    regimes = [("pre", 1995, 1996, 1997, 1997, 1998), ("post", 1997, 1998, 1999, 1999, 2000)]
    return rounded(L.study_metrics({"regimes": L.walk_forward(study_panel(d), FEATURES, LABEL, regimes, FULL)}))


@query("m14_fold_importance")
def _(d: Domain):
    _, study = full_study(d)
    return rounded(serving.normalized_gain(study.importance))


@query("m15_permutation_importance")
def _(d: Domain):
    panel, study = full_study(d)
    last = max(study.models)
    validation = E.assign_folds(panel, [f for f in FOLDS if f[0] == last]).where("role = 'val'")
    return rounded(L.permutation_importance(study.models[last], validation, FEATURES, LABEL, KEYS))


@query("m16_bolt_on")
def _(d: Domain):
    panel, bolt_on = full_study(d)
    runs = {"base": L.walk_forward(panel, ["is_rural", "population"], LABEL, FOLDS, FULL), "bolt_on": bolt_on}
    return rounded(L.study_metrics(runs))


@query("m18_spatial_robustness")
def _(d: Domain):
    panel = study_panel(d)
    splits = L.spatial_splits(panel.where(F.col(LABEL).isNotNull()), "state_fips", KEYS)
    runs = {name: L.walk_forward(panel, FEATURES, LABEL, roles, REFIT) for name, roles in splits.items()}
    return rounded(L.study_metrics(runs))


@query("m19_tuning")
def _(d: Domain):
    return rounded(L.tune(study_panel(d), FEATURES, LABEL, FOLDS[0], base=REFIT))


@query("m20_partial_dependence")
def _(d: Domain):
    panel, model, _ = full_model(d)
    return rounded(L.partial_dependence(model, panel, FEATURES, dict.fromkeys(FEATURES, "down")), 9)


@query("m21_final_model_scores")
def _(d: Domain):
    panel, model, iso = full_model(d)
    return rounded(L.calibrated(iso, L.predict(model, panel.where("year = 2000"), FEATURES)).select(*KEYS, "y_prob", "y_prob_calibrated"))


@query("m21_stored_models")
def _(d: Domain):
    panel, path = study_panel(d), fresh_path(d.spark, "models")
    L.save_models(L.final_models(panel, MODELS, LABELS, 2001, FULL), path)
    loaded = L.load_models(path, [(name, h) for name in MODELS for h in HORIZONS])
    return rounded(L.score_models(panel.where("year = 2001"), loaded, MODELS, KEYS))


@query("m23_score_latest_year")
def _(d: Domain):
    panel, study = full_study(d)
    fold = max(study.models)
    latest = panel.where("year = 2001")
    return rounded(L.calibrated(study.calibrations[fold], L.predict(study.models[fold], latest, FEATURES)).select(*KEYS, "y_prob", "y_prob_calibrated"))


@query("m22_linear_attribution", """
    WITH m AS (SELECT avg(n_loans) AS a, avg(n_small) AS b, avg(is_rural) AS c FROM d_panel)
    SELECT tract_fips, year, 'n_loans' AS feature, round((n_loans - a) * -0.05::DOUBLE, 9) + 0.0 AS attribution FROM d_panel, m
    UNION ALL SELECT tract_fips, year, 'n_small', round((n_small - b) * 0.11::DOUBLE, 9) + 0.0 FROM d_panel, m
    UNION ALL SELECT tract_fips, year, 'is_rural', round((is_rural - c) * 0.4::DOUBLE, 9) + 0.0 FROM d_panel, m""")
def _(d: Domain):
    return rounded(L.linear_attributions(d.panel(), KEYS, {"n_loans": -0.05, "n_small": 0.11, "is_rural": 0.4}), 9)


@query("m22_tree_attribution")
def _(d: Domain):
    panel, model, _ = full_model(d)
    long = L.tree_attributions(model, panel.where("year = 2001"), FEATURES, KEYS)
    return rounded(serving.top_attributions(long.withColumn("attribution", F.round("attribution", 9)), KEYS, 3))
