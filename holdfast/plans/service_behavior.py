"""Service behaviour: adoption of social, night, pack and data-recharge services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import specs as S
from holdfast.functions import service_rules  # noqa: F401  (registers the bands)
from holdfast.functions.bands import condition
from holdfast.operators.gate import counter_gate
from holdfast.plans.common import customers, with_churners

C = F.col
GUARD = {"min_customers": S.MIN_CUSTOMERS}


def service_snapshot(df: DataFrame) -> DataFrame:
    users = {
        "social_service_users": condition("social_user"),
        "night_service_users": condition("night_user"),
        "monthly_2g_users": C("monthly_2g_8") > 0,
        "sachet_2g_users": C("sachet_2g_8") > 0,
        "monthly_3g_users": C("monthly_3g_8") > 0,
        "sachet_3g_users": C("sachet_3g_8") > 0,
        "data_recharge_users": condition("data_recharged"),
        "missing_data_recharge_information": condition("data_unknown"),
    }
    return df.agg(customers().alias("customers"), *[F.count_if(c).alias(k) for k, c in users.items()])


def service_gate(df: DataFrame) -> DataFrame:
    counters = {
        "missing_target": C("label").isNull(),
        "missing_data_recharge_information": C("total_rech_data_8").isNull(),
        "missing_social_service_information": C("fb_user_8").isNull(),
        "missing_night_service_information": C("night_pck_user_8").isNull(),
    }
    names = {"rows": "row_count", "distinct": "distinct_customer_ids", "duplicates": "duplicate_id_count"}
    return counter_gate(df, counters, names, "analytical_quality_gate", zero=("missing_target",))


SIGNAL_METRICS = {
    "customers": S.Count(),
    "customer_share_pct": S.Share(),
    "churners": S.Churners(),
    "observed_churn_rate_pct": S.Rate(),
    "churn_contribution_pct": S.Contribution(),
}

REPORTS = {
    "s06_01_service_snapshot": service_snapshot,
    "s06_02_social_adoption": with_churners({"adoption_status": "social_adoption"}),
    "s06_03_night_adoption": with_churners({"adoption_status": "night_adoption"}),
    "s06_04_g2_adoption": with_churners({"service_group": "g2_packs"}),
    "s06_05_g3_adoption": with_churners({"service_group": "g3_packs"}),
    "s06_06_monthly_vs_sachet": with_churners({"service_mix_group": "pack_mix"}, **GUARD),
    "s06_07_data_recharge_participation": with_churners({"data_recharge_status": "data_recharge_status"}),
    "s06_08_data_service_trajectory": with_churners({"trajectory_group": "data_service_course"}),
    "s06_09_service_breadth": with_churners({"breadth_group": "breadth_or_unknown"}),
    "s06_10_service_archetypes": with_churners({"service_archetype": "service_archetype"}, **GUARD),
    "s06_11_service_x_value": with_churners({"value_band": "revenue_arpu", "breadth_group": "breadth"}, **GUARD),
    "s06_12_service_x_churn": S.Stacked(
        ("service_dimension", "service_group"),
        (
            ("Social service", "social_adoption", None),
            ("Night service", "night_adoption", None),
            ("Data recharge service", "data_recharge_status", None),
            ("2G service", "any_g2", None),
            ("3G service", "any_g3", None),
        ),
        SIGNAL_METRICS,
        **GUARD,
    ),
    "s06_13_service_consistency": with_churners(
        {
            "social_consistency": "social_course",
            "night_consistency": "night_course",
            "data_consistency": "data_course",
        },
        **GUARD,
    ),
    "s06_14_service_signals": S.Stacked(
        ("signal_dimension", "signal"),
        (
            ("Data service", "const:Recorded data recharge users", "data_recharged"),
            ("Data service", "const:Information unavailable", "data_unknown"),
            ("Social service", "const:Social service adopted", "social_user"),
            ("Night service", "const:Night service adopted", "night_user"),
            ("2G service", "const:Any recorded 2G service", "g2_user"),
            ("3G service", "const:Any recorded 3G service", "g3_user"),
        ),
        SIGNAL_METRICS,
        **GUARD,
    ),
    "s06_15_quality_gate": service_gate,
}
