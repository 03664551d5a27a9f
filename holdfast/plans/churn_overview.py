"""Churn overview: churn rate and contribution by tenure, value, usage and recharge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import specs as S
from holdfast.operators.gate import status
from holdfast.plans.common import churn_band, churn_rate, churners, customers


def churn_snapshot(df: DataFrame) -> DataFrame:
    return df.agg(
        customers().alias("total_customers"),
        churners().alias("churned_customers"),
        F.count_if(F.col("label") == 0).alias("retained_customers"),
        churn_rate().alias("churn_rate_pct"),
    )


def readiness_gate(df: DataFrame) -> DataFrame:
    n, distinct = customers(), F.count_distinct("id")
    valid = F.count_if(F.col("label").isin(0, 1))
    return df.agg(
        n.alias("total_rows"),
        distinct.alias("distinct_customer_ids"),
        valid.alias("valid_target_rows"),
        status((n > 0) & (distinct == n) & (valid == n)).alias("analytical_readiness"),
    )


VALUE_BY_ENGAGEMENT = {"value_group": "arpu_group", "engagement_group": "voice_presence"}

REPORTS = {
    "s02_01_churn_snapshot": churn_snapshot,
    "s02_02_churn_distribution": S.Profile(
        {"churn_flag": "label_text", "customer_status": "churn_status"},
        {"customers": S.Count(), "customer_share_pct": S.Share()},
    ),
    "s02_03_churn_by_tenure": churn_band("tenure_band", "tenure_overview", where="has_tenure"),
    "s02_04_churn_by_value": churn_band("arpu_band", "arpu_overview"),
    "s02_05_churn_by_outgoing": churn_band("outgoing_usage_band", "outgoing_overview"),
    "s02_06_churn_by_incoming": churn_band("incoming_usage_band", "incoming_overview"),
    "s02_07_churn_by_recharge_value": churn_band("recharge_value_band", "recharge_overview"),
    "s02_08_churn_by_recharge_freq": churn_band("recharge_frequency_band", "frequency_overview"),
    "s02_09_churn_by_data_status": churn_band("data_engagement_status", "data_status"),
    "s02_10_churn_by_data_volume": churn_band("data_usage_band", "data_volume_overview"),
    "s02_11_churn_by_voice_total": churn_band("voice_engagement_band", "voice_overview"),
    "s02_12_churn_value_x_engagement": S.Profile(VALUE_BY_ENGAGEMENT, churn_band("x", "arpu_group").show),
    "s02_13_churn_by_info_availability": churn_band("data_information_status", "data_information"),
    "s02_14_retained_vs_churned_profile": S.Profile(
        {"customer_status": "churn_or_retained"},
        {
            "customers": S.Count(),
            "avg_tenure_days": S.Mean("aon", digits=1),
            "avg_august_arpu": S.Mean("arpu_8"),
            "avg_august_recharge_amount": S.Mean("total_rech_amt_8"),
            "avg_august_recharge_count": S.Mean("total_rech_num_8"),
            "avg_august_outgoing_minutes": S.Mean("total_og_mou_8"),
            "avg_august_incoming_minutes": S.Mean("total_ic_mou_8"),
            "avg_august_2g_mb": S.Mean("vol_2g_mb_8"),
            "avg_august_3g_mb": S.Mean("vol_3g_mb_8"),
        },
    ),
    "s02_15_churn_signals": S.Stacked(
        ("signal",),
        (
            ("Low August ARPU", None, "low_arpu"),
            ("Very low outgoing voice usage", None, "low_outgoing"),
            ("Very low incoming voice usage", None, "low_incoming"),
            ("Low August recharge value", None, "low_recharge"),
            ("Less than one year tenure", None, "short_tenure"),
            ("No August voice usage", None, "no_voice"),
        ),
        {
            "customers": S.Count(),
            "customer_share_pct": S.Share(),
            "churn_rate_pct": S.Rate(),
            "churn_rate_rank": S.Standing(S.Rate()),
        },
        min_population_share=1.0,
    ),
    "s02_16_quality_gate": readiness_gate,
}
