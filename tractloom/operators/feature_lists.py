"""Which panel columns a model may see."""

from __future__ import annotations

import re

# Features a policy can influence, the only inputs of the lever model.
INFLUENCEABLE = [
    "pct_loans_from_community_banks_resid", "pct_loans_from_top4_banks_resid", "pct_loans_from_credit_unions_resid",
    "pct_loans_under_100k_resid", "pct_loans_under_250k_resid",
    "top1_lender_share_tract_resid", "top3_lender_share_tract_resid", "lender_hhi_tract_resid",
    "distance_to_nearest_bank_branch", "branches_within_5mi", "branch_closures_3y_within_10mi",
    "microloan_intermediary_within_25mi",
    "mdi_branches_within_10mi", "mdi_branches_within_25mi", "nearest_mdi_branch_miles", "mdi_active_in_county",
    "ssbci_active", "ssbci_2_0_active", "ssbci_program_count", "ssbci_n_capital_programs",
]

# Columns that identify rows, define the label, or restate the lender count behind it.
EXCLUDED = [
    "tract_fips", "county_fips", "state_fips", "peer_group", "service_desert_threshold",
    "service_peer_median", "origination_desert_threshold",
    "originations_per_1k", "service_desert_score", "origination_desert_score",
    "is_service_desert", "is_origination_desert", "is_any_desert",
    "vintage", "acs_vintage_used",
    "n_cra_lenders",
    "cra_lender_entries_1yr", "cra_lender_exits_1yr", "cra_lender_churn_1yr", "cra_lender_presence_ratio_1yr",
    "cra_lender_entries_3yr", "cra_lender_exits_3yr", "cra_lender_churn_3yr",
    "cra_county_lender_count", "cra_county_total_loan_count", "cra_county_total_loan_amount_k",
    "fdic_bank_count", "fdic_branch_count",
    "fdic_bank_count_chg1yr", "fdic_bank_count_chg3yr",
    "fdic_branch_count_chg1yr", "fdic_branch_count_chg3yr",
    "fdic_total_branch_deposits_k",
    "fdic_total_branch_deposits_k_chg1yr", "fdic_total_branch_deposits_k_chg3yr",
    "fdic_total_branch_deposits_k_pctchg1yr", "fdic_total_branch_deposits_k_pctchg3yr",
    "fdic_avg_branch_deposits_k", "fdic_avg_branch_deposits_k_chg1yr", "fdic_avg_branch_deposits_k_chg3yr",
]
#: Labels, whatever the horizon: columns named ``target_...``, and those that ``temporal.forward_labels`` adds.
LABEL_NAME = re.compile(r"target_.*|(state|becomes)_is_.*_h\d+")


def leaks_label(column: str) -> bool:
    return column in EXCLUDED or LABEL_NAME.fullmatch(column) is not None


def numeric_columns(dtypes: list[tuple[str, str]]) -> list[str]:
    whole = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in dtypes if t in whole or t.startswith("decimal")]
