"""Customer segmentation: tenure, value, engagement, recharge and combined segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import specs as S
from holdfast.functions import value_rules  # noqa: F401  (registers the bands)
from holdfast.functions.bands import condition
from holdfast.functions.numeric import percent, rounded
from holdfast.operators.ranking import with_value_rank
from holdfast.plans.common import customers
from holdfast.plans.revenue_exposure import value_gate

C = F.col

# Segment size labels.
SIZE_FLAG = S.SizeFlag("Small Segment — Interpret Carefully", "Sufficient Segment Size")


def segment_universe(df: DataFrame) -> DataFrame:
    missing = {
        "missing_churn_labels": "label",
        "missing_arpu_8": "arpu_8",
        "missing_recharge_8": "total_rech_amt_8",
        "missing_outgoing_voice_8": "total_og_mou_8",
        "missing_incoming_voice_8": "total_ic_mou_8",
    }
    n, distinct = customers(), F.count_distinct("id")
    return df.agg(
        n.alias("total_customers"),
        distinct.alias("distinct_customers"),
        (n - distinct).alias("duplicate_customer_ids"),
        *[F.count_if(C(c).isNull()).alias(k) for k, c in missing.items()],
    )


def high_value_definition(df: DataFrame) -> DataFrame:
    high = condition("high_value")
    sums = with_value_rank(df.select("id", "value")).agg(
        F.count_if(high).alias("high_value_customers"),
        customers().alias("n"),
        F.coalesce(F.sum(F.when(high, C("value"))), F.lit(0.0)).alias("v"),
        F.sum("value").alias("all_v"),
    )
    return sums.select(
        "high_value_customers",
        percent("high_value_customers", "n").alias("high_value_customer_share_pct"),
        rounded("v").alias("high_value_proxy"),
        percent("v", "all_v").alias("high_value_contribution_pct"),
    )


def segments(keys: dict[str, str], extra: dict[str, object] | None = None, **options) -> S.Profile:
    return S.Profile(
        keys,
        {
            "customers": S.Count(),
            "customer_share_pct": S.Share(),
            **(extra or {}),
            "churned_customers": S.Churners(),
            "observed_churn_rate_pct": S.Rate(),
            "segment_size_flag": SIZE_FLAG,
        },
        **options,
    )


VALUE = {"value_proxy": S.Total("value"), "value_contribution_pct": S.TotalShare("value")}
VALUE_AND_CHURN = {**VALUE, "churn_customer_contribution_pct": S.Contribution()}

REPORTS = {
    "s09_01_segment_universe": segment_universe,
    "s09_02_tenure_segments": segments(
        {"tenure_segment": "segment_tenure"}, {"avg_tenure_days": S.Mean("aon", digits=0)}
    ),
    "s09_03_value_segments": segments({"value_segment": "segment_value"}, {"avg_arpu": S.Mean("arpu_8")}),
    "s09_04_high_value_definition": high_value_definition,
    "s09_05_voice_segments": segments(
        {"engagement_segment": "segment_voice"},
        {"avg_outgoing_mou": S.Mean("total_og_mou_8"), "avg_incoming_mou": S.Mean("total_ic_mou_8")},
    ),
    "s09_06_recharge_segments": segments(
        {"recharge_segment": "segment_recharge"},
        {
            "avg_recharge_amount": S.Mean("total_rech_amt_8"),
            "avg_recharge_frequency": S.Mean("total_rech_num_8"),
        },
    ),
    "s09_07_data_segments": segments(
        {"data_segment": "segment_data"}, {"avg_total_data_mb": S.Mean("data_or_zero_8")}
    ),
    "s09_08_tenure_x_value_segments": segments(
        {"tenure_segment": "col:tenure_segment", "value_group": "value_group"},
        {"avg_arpu": S.Mean("arpu_8")},
        ranked=True,
        before_rank={"tenure_segment": "segment_tenure"},
    ),
    "s09_09_value_x_engagement_segments": segments(
        {"value_group": "value_group", "engagement_group": "col:engagement_group"},
        {"avg_arpu": S.Mean("arpu_8")},
        ranked=True,
        before_rank={"engagement_group": "segment_engagement"},
    ),
    "s09_10_recharge_x_engagement": segments(
        {"recharge_group": "segment_recharge", "engagement_group": "segment_engagement"}
    ),
    "s09_11_value_x_temporal_segments": segments(
        {"value_group": "value_group", "temporal_status": "col:temporal_status"},
        VALUE,
        ranked=True,
        before_rank={"temporal_status": "decline_status"},
    ),
    "s09_12_high_value_deterioration": S.Profile(
        {"deterioration_status": "col:deterioration_status"},
        {
            "customers": S.Count(),
            "high_value_customer_share_pct": S.Share(),
            "avg_arpu_change_pct": S.Mean("arpu_change_pct"),
            "avg_recharge_change_pct": S.Mean("recharge_change_pct"),
            "segment_size_flag": SIZE_FLAG,
        },
        where="high_value",
        ranked=True,
        before_rank={"deterioration_status": "decline_status"},
    ),
    "s09_13_executive_segments": segments(
        {"executive_segment": "executive_segment"},
        VALUE_AND_CHURN,
        ranked=True,
        before_rank={"engagement_group": "segment_engagement", "recharge_group": "segment_recharge"},
    ),
    "s09_14_segment_prioritization": segments(
        {"segment_name": "priority_segment"},
        VALUE_AND_CHURN,
        ranked=True,
        before_rank={"low_engagement": "low_engagement", "thin_recharge": "thin_recharge"},
    ),
    "s09_15_quality_gate": lambda df: value_gate(
        df, "segmentation_quality_gate", zero=("missing_target_count",)
    ),
}
