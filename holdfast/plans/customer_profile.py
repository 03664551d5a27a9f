"""Customer profile: tenure, value, recharge and activity composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import specs as S
from holdfast.operators.gate import counter_gate
from holdfast.plans.common import customers, mean, observed, with_medians

GATE_NAMES = {"rows": "total_rows", "distinct": "distinct_customer_ids", "duplicates": "duplicate_customer_ids"}


def profile_snapshot(df: DataFrame) -> DataFrame:
    averages = {
        "avg_tenure_days": "aon",
        "avg_august_arpu": "arpu_8",
        "avg_august_recharge_amount": "total_rech_amt_8",
        "avg_august_recharge_count": "total_rech_num_8",
        "avg_august_outgoing_mou": "total_og_mou_8",
        "avg_august_incoming_mou": "total_ic_mou_8",
    }
    return with_medians(
        df.select(*averages.values()),
        [customers().alias("total_customers"), *[mean(m).alias(k) for k, m in averages.items()]],
        {"median_tenure_days": "aon", "median_august_arpu": "arpu_8"},
    )


def label_gate(df: DataFrame) -> DataFrame:
    return counter_gate(
        df,
        {"missing_target_values": F.col("label").isNull()},
        GATE_NAMES,
        "quality_gate_status",
        zero=("missing_target_values",),
    )


TENURE_BY_VALUE = {"tenure_band": "tenure_profile", "value_band": "value_profile"}

REPORTS = {
    "s03_01_profile_snapshot": profile_snapshot,
    "s03_02_tenure_profile": observed(
        {"tenure_band": "tenure_profile"}, {"avg_tenure_days": S.Mean("aon")}
    ),
    "s03_03_value_profile_bands": observed(
        {"arpu_band": "arpu_profile"}, {"avg_august_arpu": S.Mean("arpu_8")}
    ),
    "s03_04_recharge_value_profile": observed(
        {"recharge_value_band": "recharge_profile"}, {"avg_august_recharge_amount": S.Mean("total_rech_amt_8")}
    ),
    "s03_05_recharge_freq_profile": observed(
        {"recharge_frequency_band": "frequency_profile"}, {"avg_august_recharge_count": S.Mean("total_rech_num_8")}
    ),
    "s03_06_customer_value_profile": observed(
        {"value_profile": "value_profile"}, {"avg_august_arpu": S.Mean("arpu_8")}
    ),
    "s03_07_activity_profile": observed({"activity_profile": "activity_profile"}),
    "s03_08_recharge_recency": observed({"recharge_recency_band": "recharge_recency"}),
    "s03_09_tenure_x_value": observed(TENURE_BY_VALUE, min_customers=S.MIN_CUSTOMERS),
    "s03_10_value_x_recharge_freq": observed(
        {"value_band": "value_profile", "recharge_behavior": "recharge_behavior"}, min_customers=S.MIN_CUSTOMERS
    ),
    "s03_11_profile_archetypes": observed({"customer_archetype": "archetype"}),
    "s03_12_high_value_concentration": observed({"value_group": "high_arpu_group"}),
    "s03_13_profile_concentration": observed(TENURE_BY_VALUE, min_share=1.0),
    "s03_14_profile_signals": S.Stacked(
        ("profile_dimension", "profile_group"),
        (
            ("Tenure", "tenure_profile", None),
            ("August ARPU", "value_profile", None),
            ("August recharge frequency", "recharge_behavior", None),
        ),
        {
            "customers": S.Count(),
            "customer_share_pct": S.Share(by=("profile_dimension",)),
            "observed_churn_rate_pct": S.Rate(),
        },
        min_share=1.0,
    ),
    "s03_15_quality_gate": label_gate,
}
