"""Risk priority: value groups crossed with deterioration signals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from holdfast import specs as S
from holdfast.functions import value_rules  # noqa: F401  (registers the bands)
from holdfast.functions.numeric import rounded
from holdfast.plans.common import churn_rate, churners, customers, mean, total
from holdfast.plans.revenue_exposure import churned_value, value_gate
from holdfast.plans.segmentation import SIZE_FLAG


def risk_value_snapshot(df: DataFrame) -> DataFrame:
    return df.agg(
        customers().alias("total_customers"),
        churners().alias("observed_churned_customers"),
        churn_rate().alias("observed_churn_rate_pct"),
        mean("value").alias("avg_positive_value_proxy"),
        total("value").alias("total_positive_value_proxy"),
        rounded(churned_value()).alias("observed_churned_value_proxy"),
    )


CHURNED_VALUE = S.Total("value", churned_only=True)
EXPOSURE = {
    "customers": S.Count(),
    "customer_share_pct": S.Share(),
    "value_proxy": S.Total("value"),
    "value_contribution_pct": S.TotalShare("value"),
    "observed_churned_customers": S.Churners(),
    "churn_customer_contribution_pct": S.Contribution(),
    "observed_churn_rate_pct": S.Rate(),
    "observed_churned_value_proxy": CHURNED_VALUE,
}
FLAGGED = {**EXPOSURE, "segment_size_flag": SIZE_FLAG}
SIGNALS = {"ranked": True, "before_rank": {"decline_signals": "decline_signals"}}


def trend(name: str) -> S.Profile:
    return S.Profile(
        {name: name},
        {
            "customers": S.Count(),
            "customer_share_pct": S.Share(),
            "observed_churned_customers": S.Churners(),
            "churn_customer_contribution_pct": S.Contribution(),
            "observed_churn_rate_pct": S.Rate(),
        },
    )


REPORTS = {
    "s10_01_risk_value_snapshot": risk_value_snapshot,
    "s10_02_churn_by_value_quartile": S.Profile({"value_group": "value_quartile"}, EXPOSURE, ranked=True),
    "s10_03_high_value_exposure": S.Profile({"value_group": "value_group"}, EXPOSURE, ranked=True),
    "s10_04_arpu_deterioration": trend("arpu_trend"),
    "s10_05_recharge_deterioration": trend("recharge_trend"),
    "s10_06_engagement_deterioration": trend("engagement_trend"),
    "s10_07_value_x_deterioration": S.Profile(
        {"value_group": "value_group", "deterioration_group": "deterioration_group"}, FLAGGED, **SIGNALS
    ),
    "s10_08_priority_cohorts": S.Profile({"descriptive_priority": "priority_cohort"}, FLAGGED, **SIGNALS),
    "s10_09_priority_ranking": S.Profile(
        {"descriptive_priority": "priority_cohort"},
        {"exposure_rank": S.Standing(CHURNED_VALUE, unique=True, tie="descriptive_priority"), **FLAGGED},
        **SIGNALS,
    ),
    "s10_10_quality_gate": lambda df: value_gate(df, "quality_gate", ids="distinct_customer_ids"),
}
