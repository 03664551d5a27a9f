"""Usage and engagement: voice and data levels, mixes, courses and recent changes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from holdfast import specs as S
from holdfast.plans.common import churn_rate, customers, mean, observed
from holdfast.plans.customer_profile import label_gate


def usage_snapshot(df: DataFrame) -> DataFrame:
    return df.agg(
        customers().alias("total_customers"),
        mean("total_og_mou_8").alias("avg_august_outgoing_mou"),
        mean("total_ic_mou_8").alias("avg_august_incoming_mou"),
        mean("onnet_mou_8").alias("avg_august_onnet_mou"),
        mean("offnet_mou_8").alias("avg_august_offnet_mou"),
        mean("vol_2g_mb_8").alias("avg_august_2g_mb"),
        mean("vol_3g_mb_8").alias("avg_august_3g_mb"),
        churn_rate().alias("overall_observed_churn_rate_pct"),
    )


REPORTS = {
    "s04_01_usage_snapshot": usage_snapshot,
    "s04_02_outgoing_profile": observed(
        {"outgoing_usage_band": "outgoing_level"}, {"avg_outgoing_mou": S.Mean("total_og_mou_8")}
    ),
    "s04_03_incoming_profile": observed(
        {"incoming_usage_band": "incoming_level"}, {"avg_incoming_mou": S.Mean("total_ic_mou_8")}
    ),
    "s04_04_voice_engagement": observed(
        {"voice_engagement_band": "voice_engagement"}, {"avg_total_voice_mou": S.Mean("voice_8")}
    ),
    "s04_05_onnet_vs_offnet": observed({"network_usage_profile": "network_usage"}),
    "s04_06_local_vs_std": observed({"local_std_profile": "local_std"}),
    "s04_07_roaming_bands": observed({"roaming_usage_band": "roaming"}),
    "s04_08_voice_balance": observed({"voice_balance_profile": "voice_balance"}),
    "s04_09_voice_consistency": observed({"voice_consistency_profile": "voice_consistency"}),
    "s04_10_voice_deterioration": observed(
        {"voice_change_profile": "voice_change"}, {"avg_voice_change_pct": S.Mean("voice_change_pct")}
    ),
    "s04_11_voice_trajectory": observed({"voice_trajectory": "voice_trajectory"}),
    "s04_12_data_profile": observed(
        {"data_usage_band": "data_usage_level"}, {"avg_total_data_mb": S.Mean("data_8")}
    ),
    "s04_13_g2_vs_g3": observed({"data_mix_profile": "data_mix"}),
    "s04_14_data_consistency": observed({"data_consistency_profile": "data_consistency"}),
    "s04_15_data_deterioration": observed(
        {"data_change_profile": "data_change"}, {"avg_data_change_pct": S.Mean("data_change_pct")}
    ),
    "s04_16_voice_x_data_matrix": observed(
        {"voice_band": "voice_cell", "data_band": "data_cell"},
        min_customers=S.MIN_CUSTOMERS,
        guard="after_share",
    ),
    "s04_17_engagement_trajectory": observed({"engagement_trajectory": "engagement_course"}),
    "s04_18_low_engagement_concentration": observed({"engagement_group": "joint_engagement"}),
    "s04_19_engagement_signals": S.Stacked(
        ("profile_dimension", "profile_group"),
        (
            ("Outgoing voice", "outgoing_signal", None),
            ("Incoming voice", "incoming_signal", None),
            ("Data engagement", "data_signal", None),
            ("Voice deterioration", "voice_direction", None),
            ("Data deterioration", "data_direction", None),
        ),
        {
            "customers": S.Count(),
            "customer_share_pct": S.Share(by=("profile_dimension",)),
            "observed_churn_rate_pct": S.Rate(),
        },
        min_customers=S.MIN_CUSTOMERS,
    ),
    "s04_20_quality_gate": label_gate,
}
