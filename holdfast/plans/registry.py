"""All descriptive reports by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from holdfast.functions.measures import with_measures
from holdfast.operators.profile import report
from holdfast.plans import (
    churn_overview,
    customer_profile,
    data_quality,
    recharge_revenue,
    revenue_exposure,
    risk_priority,
    segmentation,
    service_behavior,
    temporal_behavior,
    usage_engagement,
)
from holdfast.specs import Profile, Stacked

MODULES = (
    data_quality,
    churn_overview,
    customer_profile,
    usage_engagement,
    recharge_revenue,
    service_behavior,
    temporal_behavior,
    revenue_exposure,
    segmentation,
    risk_priority,
)

REPORTS: dict[str, Profile | Stacked | Callable[[DataFrame], DataFrame]] = {
    name: plan for module in MODULES for name, plan in module.REPORTS.items()
}


def run_report(name: str, panel: DataFrame) -> DataFrame:
    """Run one report over a customer panel."""
    plan, rows = REPORTS[name], with_measures(panel)
    return report(rows, plan) if isinstance(plan, Profile | Stacked) else plan(rows)
