"""Temporal behaviour: three-period trajectories, directions and deterioration signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import PERIODS
from holdfast import specs as S
from holdfast.functions import service_rules  # noqa: F401  (registers the bands)
from holdfast.functions.bands import condition
from holdfast.functions.numeric import percent
from holdfast.functions.periods import fell
from holdfast.functions.service_rules import incomplete
from holdfast.operators.gate import counter_gate
from holdfast.plans.common import customers, mean

MONTHS = {6: "june", 7: "july", 8: "august"}


def temporal_snapshot(df: DataFrame) -> DataFrame:
    measures = {
        "arpu": "arpu",
        "recharge": "total_rech_amt",
        "outgoing": "total_og_mou",
        "incoming": "total_ic_mou",
        "2g": "vol_2g_mb",
        "3g": "vol_3g_mb",
    }
    averages = [mean(f"{m}_{p}").alias(f"avg_{k}_{MONTHS[p]}") for k, m in measures.items() for p in PERIODS]
    return df.agg(customers().alias("customer_count"), *averages)


def counted(keys: dict[str, str], extra: dict[str, object] | None = None) -> S.Profile:
    return S.Profile(keys, {"customers": S.Count(), "customer_share_pct": S.Share(), **(extra or {})})


def temporal_signals(df: DataFrame) -> DataFrame:
    """One row: how many customers each movement applies to, and their share."""
    signals = {
        "arpu_declining": fell("arpu"),
        "recharge_declining": fell("total_rech_amt"),
        "outgoing_declining": fell("total_og_mou"),
        "incoming_declining": fell("total_ic_mou"),
        "broad_deterioration": condition("broad_deterioration"),
        "broad_improvement": condition("broad_improvement"),
    }
    counts = df.agg(
        customers().alias("total_customers"), *[F.count_if(c).alias(k) for k, c in signals.items()]
    )
    out = ["total_customers"]
    for k in signals:
        out += [k, percent(k, "total_customers").alias(f"{k}_pct")]
    return counts.select(*out)


def temporal_gate(df: DataFrame) -> DataFrame:
    counters = {
        "missing_targets": F.col("label").isNull(),
        "incomplete_arpu_history": incomplete("arpu"),
        "incomplete_recharge_history": incomplete("total_rech_amt"),
        "incomplete_outgoing_history": incomplete("total_og_mou"),
        "incomplete_incoming_history": incomplete("total_ic_mou"),
    }
    names = {"rows": "row_count", "distinct": "distinct_customer_ids", "duplicates": "duplicate_customer_ids"}
    return counter_gate(df, counters, names, "analytical_quality_gate", zero=("missing_targets",))


REPORTS = {
    "s07_01_temporal_snapshot": temporal_snapshot,
    "s07_02_arpu_trajectory": counted({"arpu_trajectory": "arpu_course"}, {"avg_august_arpu": S.Mean("arpu_8")}),
    "s07_03_arpu_direction": counted(
        {"arpu_direction": "arpu_direction"},
        {"avg_absolute_change": S.Mean("arpu_change_6_8"), "avg_pct_change": S.Mean("arpu_change_6_8_pct")},
    ),
    "s07_04_recharge_trajectory": counted(
        {"recharge_trajectory": "recharge_course"}, {"avg_august_recharge": S.Mean("total_rech_amt_8")}
    ),
    "s07_05_recharge_direction": counted(
        {"recharge_direction": "recharge_direction"},
        {"avg_absolute_change": S.Mean("recharge_change_6_8"), "avg_pct_change": S.Mean("recharge_change_6_8_pct")},
    ),
    "s07_06_voice_trajectory": counted(
        {"outgoing_trajectory": "outgoing_course", "incoming_trajectory": "incoming_course"}
    ),
    "s07_07_voice_change_pattern": counted({"voice_change_pattern": "voice_change_pattern"}),
    "s07_08_data_trajectory": counted({"data_trajectory": "data_trajectory"}),
    "s07_09_multi_domain_deterioration": counted({"deterioration_domain_count": "deterioration_domains"}),
    "s07_10_temporal_profile": counted({"temporal_profile": "temporal_profile"}),
    "s07_11_vs_baseline": counted({"recent_vs_baseline_profile": "versus_baseline"}),
    "s07_12_temporal_x_value": S.Profile(
        {"value_band": "temporal_value", "temporal_profile": "broad_movement"},
        {
            "customers": S.Count(),
            "profile_share_within_value_band_pct": S.Share(by=("value_band",)),
            "avg_august_arpu": S.Mean("arpu_8"),
        },
    ),
    "s07_13_temporal_x_churn": counted(
        {"temporal_profile": "broad_movement_all"},
        {
            "observed_churned_customers": S.Churners(),
            "observed_churn_rate_pct": S.Rate(),
            "churn_contribution_pct": S.Contribution(),
        },
    ),
    "s07_14_persistent_deterioration": counted(
        {"persistent_decline_domains": "persistent_declines"}, {"observed_churn_rate_pct": S.Rate()}
    ),
    "s07_15_temporal_signals": temporal_signals,
    "s07_16_quality_gate": temporal_gate,
}
