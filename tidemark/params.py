"""Run parameters of all jobs in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Params:
    # They must equal the published defaults for results to agree.
    as_of: datetime | None = None
    livemode_only: bool = True
    reporting_currency: str = "USD"
    experiment_flags: tuple[str, ...] = ("suite-default-model-create-image", "suite-default-model-create-video")
    click_id_keys: tuple[str, ...] = (
        "gclid", "gbraid", "wbraid", "fbclid", "msclkid", "ttclid", "rdt_cid", "twclid", "li_fat_id", "oppref",
    )
    utm_keys: tuple[str, ...] = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id")
    holdout_key_pattern: str = "[0-5]$"
    clock_skew_seconds: int = 300
    lookback_days: int = 3
    max_late_days: int = 30
    # usage cost
    vendor_discount_pct: float = 0.0
    vendor_discounts: dict[str, float] = field(default_factory=dict)
    failed_cost_share: float = 0.0
    default_cost_per_credit: float = 0.0020
    trial_min_credits: int = 5
    # fees
    fee_pct: float = 0.036
    fee_fixed: float = 0.30
    affiliate_pct: float = 0.20
    dispute_fee: float = 15.0
    # 24-hour score
    horizon_days: int = 90
    maturity_days: int = 30
    folds: int = 5
    backtest_weeks: int = 8
    mae_cap: float = 500.0
    cpc_prior_credits: float = 20000.0
    prior_not_activated: float = 0.005
    prior_activated: float = 0.05
    prior_depleted: float = 0.08
    prior_users: float = 200.0
    use_arm_calibration: bool = False
    prior_revenue: float = 110.0
    prior_paid_credits: float = 8000.0
    prior_charges: float = 2.0
    prior_converters: float = 5.0
    monthly_retention: float = 0.80
    plan_utilization: float = 0.40
    video_credit_share: float = 0.85
    trial_leftover_share: float = 0.50
    refund_prob: float = 0.02
    chargeback_prob: float = 0.005
    # purchase value score
    interval_coverage: float = 0.8
    renewal_prior: float = 10.0
    renewal_country_prior: float = 20.0
    prior_addon_per_month: float = 1.0
    addon_prior_months: float = 50.0
    util_prior_credits: float = 40000.0
    prior_burn_cv: float = 0.6
    prior_pack_revenue: float = 5.0
    prior_pack_q90: float = 30.0
    pack_prior: float = 10.0
    rate_prior_charges: float = 200.0
    user_cpc_prior_credits: float = 2000.0
    burn_prior_months: float = 2.0
    # audiences and readout
    seed_top_share: float = 0.20
    seed_min_profit: float = 1.0
    low_profit_threshold: float = 1.0
    ci_z: float = 1.96
    bootstrap_replicates: int = 200
    min_matured_for_arm_error: int = 30
    cuped_prior_users: float = 50.0
    value_cap: float = 500.0
    pp_model_version: str = "v0.2-heuristic-eb-xf"
    pvs_model_version: str = "pvs-v0.1-structural-eb-xf"


# Two-sided normal quantiles by interval coverage (fixed values).
Z_BY_COVERAGE = {0.5: 0.6745, 0.6: 0.8416, 0.7: 1.0364, 0.8: 1.2816, 0.9: 1.6449, 0.95: 1.96}

# Upper bounds of the Poisson(1) inverse CDF: weight i below bound i, else 6 (fixed values).
POISSON_BOUNDS = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)
