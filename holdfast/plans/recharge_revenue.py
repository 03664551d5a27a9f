"""Recharge and revenue: value bands, recharge behaviour, changes and value contribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import specs as S
from holdfast.operators.gate import counter_gate
from holdfast.plans.common import customers, mean, with_churners, with_medians


def revenue_snapshot(df: DataFrame) -> DataFrame:
    averages = {
        "avg_tenure_days": "aon",
        "avg_august_arpu": "arpu_8",
        "avg_august_recharge_amount": "total_rech_amt_8",
        "avg_august_recharge_frequency": "total_rech_num_8",
        "avg_august_outgoing_mou": "total_og_mou_8",
        "avg_august_incoming_mou": "total_ic_mou_8",
    }
    return with_medians(
        df.select(*averages.values()),
        [
            customers().alias("customers"),
            *[mean(m).alias(k) for k, m in averages.items()],
            F.count_if(F.col("arpu_8") < 0).alias("negative_arpu_customers"),
            F.count_if(F.col("arpu_8") == 0).alias("zero_arpu_customers"),
            F.count_if(F.col("total_rech_amt_8") == 0).alias("zero_recharge_amount_customers"),
        ],
        {"median_august_arpu": "arpu_8", "median_august_recharge_amount": "total_rech_amt_8"},
    )


def revenue_gate(df: DataFrame) -> DataFrame:
    counters = {
        "missing_august_arpu": F.col("arpu_8").isNull(),
        "missing_august_recharge_amount": F.col("total_rech_amt_8").isNull(),
        "missing_august_recharge_frequency": F.col("total_rech_num_8").isNull(),
        "negative_recharge_amounts": F.col("total_rech_amt_8") < 0,
    }
    names = {"rows": "row_count", "distinct": "distinct_customer_ids", "duplicates": "duplicate_id_count"}
    return counter_gate(df, counters, names, "analytical_quality_gate", zero=tuple(counters))


GUARD = {"min_customers": S.MIN_CUSTOMERS}

REPORTS = {
    "s05_01_revenue_snapshot": revenue_snapshot,
    "s05_02_arpu_profile": with_churners(
        {"arpu_band": "revenue_arpu"}, {"avg_arpu": S.Mean("arpu_8")}, contribution=True
    ),
    "s05_03_recharge_profile": with_churners(
        {"recharge_band": "revenue_recharge"}, {"avg_recharge_amount": S.Mean("total_rech_amt_8")}, contribution=True
    ),
    "s05_04_frequency_profile": with_churners(
        {"frequency_band": "revenue_frequency"},
        {"avg_recharge_frequency": S.Mean("total_rech_num_8")},
        contribution=True,
    ),
    "s05_05_amount_x_frequency": with_churners(
        {"amount_band": "amount_band", "frequency_band": "revenue_frequency"},
        {"avg_recharge_amount": S.Mean("total_rech_amt_8")},
        **GUARD,
    ),
    "s05_06_arpu_x_recharge": with_churners(
        {"arpu_band": "revenue_arpu", "recharge_band": "recharge_cell"},
        {"avg_arpu": S.Mean("arpu_8"), "avg_recharge": S.Mean("total_rech_amt_8")},
        **GUARD,
    ),
    "s05_07_arpu_x_engagement": with_churners(
        {"value_band": "revenue_value", "engagement_band": "revenue_engagement"}, **GUARD
    ),
    "s05_08_arpu_change": with_churners(
        {"change_band": "arpu_change_band"}, {"avg_arpu_change": S.Mean("arpu_change")}
    ),
    "s05_09_recharge_change": with_churners(
        {"change_band": "recharge_change_band"}, {"avg_recharge_change": S.Mean("recharge_change")}
    ),
    "s05_10_recharge_consistency": with_churners({"consistency_band": "recharge_consistency"}),
    "s05_11_value_concentration": with_churners(
        {"value_band": "revenue_arpu"},
        {"total_arpu_value_proxy": S.Total("value"), "arpu_value_contribution_pct": S.TotalShare("value")},
    ),
    "s05_12_high_value_concentration": with_churners(
        {"value_segment": "high_value_threshold"},
        {"total_arpu_value_proxy": S.Total("value"), "value_contribution_pct": S.TotalShare("value")},
    ),
    "s05_13_high_value_declining_recharge": with_churners({"customer_signal": "value_recharge_signal"}, **GUARD),
    "s05_14_recharge_semantics": with_churners({"recharge_semantic_group": "recharge_semantics"}),
    "s05_15_value_contribution": S.Profile(
        {"value_band": "revenue_arpu"},
        {
            "customers": S.Count(),
            "customer_share_pct": S.Share(),
            "arpu_value_proxy": S.Total("value"),
            "value_contribution_pct": S.TotalShare("value"),
        },
    ),
    "s05_16_revenue_signals": S.Stacked(
        ("signal_dimension", "signal"),
        (
            ("Customer value", "const:Higher-value customers", "high_arpu"),
            ("Recharge behavior", "const:Zero August recharge amount", "zero_recharge"),
            ("Combined value signal", "const:Higher-value + declining recharge", "high_arpu_falling_recharge"),
            ("ARPU trend", "const:ARPU declined by more than 50%", "arpu_halved"),
            ("Recharge trend", "const:Recharge declined by more than 50%", "recharge_halved"),
        ),
        {
            "customers": S.Count(),
            "customer_share_within_dimension_pct": S.Share(by=("signal_dimension",)),
            "churners": S.Churners(),
            "observed_churn_rate_pct": S.Rate(),
            "churn_contribution_within_dimension_pct": S.Contribution(by=("signal_dimension",)),
        },
        min_customers=S.MIN_CUSTOMERS,
    ),
    "s05_17_quality_gate": revenue_gate,
}
