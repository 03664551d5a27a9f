"""Revenue exposure: value distribution, concentration and observed churned value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import specs as S
from holdfast.functions import value_rules  # noqa: F401  (registers the bands)
from holdfast.functions.bands import condition
from holdfast.functions.numeric import percent, rounded
from holdfast.operators.gate import counter_gate
from holdfast.operators.ranking import global_rank, tile, with_value_rank
from holdfast.plans.common import customers, mean, total

C = F.col


def churned_value() -> Column:
    return F.coalesce(F.sum(F.when(condition("churned"), C("value"))), F.lit(0.0))


def _sum_if(cond: Column, value: str = "value") -> Column:
    return F.coalesce(F.sum(F.when(cond, C(value))), F.lit(0.0))


def value_snapshot(df: DataFrame) -> DataFrame:
    return df.agg(
        customers().alias("total_customers"),
        F.count_distinct("id").alias("distinct_customers"),
        mean("arpu_8").alias("avg_august_arpu"),
        rounded(F.min("arpu_8")).alias("min_august_arpu"),
        rounded(F.max("arpu_8")).alias("max_august_arpu"),
        total("value").alias("total_positive_august_value_proxy"),
        rounded(churned_value()).alias("observed_churned_value_proxy"),
    )


def churned_value_exposure(df: DataFrame) -> DataFrame:
    return df.filter(condition("churned")).agg(
        customers().alias("churned_customers"),
        total("value").alias("observed_churned_value_proxy"),
        mean("value").alias("avg_churned_value_proxy"),
        rounded(F.min("value")).alias("min_churned_value_proxy"),
        rounded(F.max("value")).alias("max_churned_value_proxy"),
    )


def pareto_deciles(df: DataFrame) -> DataFrame:
    """Value deciles, highest first, with a running share over the ten rows."""
    ranked = global_rank(df.select("id", "value"), [C("value").desc(), C("id").asc()])
    deciles = (
        ranked.groupBy(tile(10).alias("value_decile"))
        .agg(customers().alias("customers"), F.sum("value").alias("v"))
    )
    upto = F.sum("v").over(Window.orderBy("value_decile").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("v").over(Window.partitionBy())
    return deciles.select(
        "value_decile",
        "customers",
        rounded("v").alias("value_proxy"),
        percent("v", whole).alias("value_share_pct"),
        percent(upto, whole).alias("cumulative_value_share_pct"),
    )


def _value_ranked(df: DataFrame, *columns: str) -> DataFrame:
    return with_value_rank(df.select("id", "label", "value", *columns))


def high_value_share(df: DataFrame) -> DataFrame:
    high = condition("high_value")
    sums = _value_ranked(df).agg(
        F.count_if(high).alias("high_value_customers"),
        customers().alias("n"),
        _sum_if(high).alias("v"),
        F.sum("value").alias("all_v"),
    )
    return sums.select(
        "high_value_customers",
        percent("high_value_customers", "n").alias("customer_share_pct"),
        rounded("v").alias("high_value_proxy"),
        percent("v", "all_v").alias("value_share_pct"),
    )


def high_value_churn(df: DataFrame) -> DataFrame:
    churned = condition("churned")
    high = condition("high_value") & churned
    sums = _value_ranked(df).agg(
        F.count_if(high).alias("high_value_churned_customers"),
        F.count_if(churned).alias("n"),
        _sum_if(high).alias("v"),
        _sum_if(churned).alias("all_v"),
    )
    return sums.select(
        "high_value_churned_customers",
        percent("high_value_churned_customers", "n").alias("share_of_churned_customers_pct"),
        rounded("v").alias("high_value_churned_proxy"),
        percent("v", "all_v").alias("share_of_churned_value_proxy_pct"),
    )


def _high_value_decline(df: DataFrame, measure: str, change: str, out: str) -> DataFrame:
    """High-value customers whose measure fell: how many, which share, and by how much on average."""
    high = condition("high_value")
    fallen = high & (C(f"{measure}_8") < C(f"{measure}_7"))
    sums = _value_ranked(df, f"{measure}_7", f"{measure}_8", change).agg(
        F.count_if(fallen).alias("declining_customers"),
        F.count_if(high).alias("n"),
        F.avg(F.when(fallen, C(change))).alias("change"),
    )
    return sums.select(
        "declining_customers",
        percent("declining_customers", "n").alias("share_of_high_value_customers_pct"),
        rounded("change").alias(out),
    )


def scenario_exposure(df: DataFrame) -> DataFrame:
    """Churned value and three fixed fractions of it. The label is 0/1, so both sums are equal."""
    sums = df.agg(F.sum(C("label") * C("value")).alias("w"), churned_value().alias("v"))
    return sums.select(
        rounded("w").alias("probability_weighted_value_exposure"),
        rounded("v").alias("observed_churned_value_proxy"),
        rounded(C("v") * 0.75).alias("conservative_recovery_scenario"),
        rounded(C("v") * 0.50).alias("expected_recovery_scenario"),
        rounded(C("v") * 0.25).alias("optimistic_recovery_scenario"),
    )


def value_signals(df: DataFrame) -> DataFrame:
    high, churned = condition("high_value"), condition("churned")
    sums = _value_ranked(df).agg(
        customers().alias("total_customers"),
        F.count_if(high).alias("high_value_customers"),
        F.count_if(high & churned).alias("high_value_churned_customers"),
        F.sum("value").alias("all_v"),
        _sum_if(high).alias("v"),
        _sum_if(high & churned).alias("churned_v"),
    )
    return sums.select(
        "total_customers",
        "high_value_customers",
        "high_value_churned_customers",
        rounded("all_v").alias("total_value_proxy"),
        rounded("v").alias("high_value_proxy"),
        rounded("churned_v").alias("high_value_observed_churn_exposure"),
        percent("v", "all_v").alias("high_value_share_of_total_value_pct"),
        percent("churned_v", "v").alias("high_value_observed_churn_exposure_pct"),
    )


MISSING = {
    "missing_target_count": "label",
    "missing_arpu_8_count": "arpu_8",
    "missing_recharge_8_count": "total_rech_amt_8",
}


def value_gate(
    df: DataFrame, status_name: str, ids: str = "distinct_ids", zero: tuple[str, ...] = tuple(MISSING)
) -> DataFrame:
    counters = {k: C(c).isNull() for k, c in MISSING.items()}
    names = {"rows": "total_rows", "distinct": ids, "duplicates": "duplicate_id_count"}
    return counter_gate(df, counters, names, status_name, zero=zero)


CHURN = {"customers": S.Count(), "churned_customers": S.Churners(), "observed_churn_rate_pct": S.Rate()}


def _by_value_group(name: str, band: str, averages: dict[str, object] | None = None) -> S.Profile:
    return S.Profile(
        {"value_group": "value_group", name: f"col:{name}"},
        {**CHURN, **(averages or {})},
        ranked=True,
        before_rank={name: band},
    )


REPORTS = {
    "s08_01_value_snapshot": value_snapshot,
    "s08_02_value_distribution": S.Profile(
        {"value_band": "exposure_value"},
        {
            "customers": S.Count(),
            "customer_share_pct": S.Share(),
            "avg_arpu": S.Mean("arpu_8"),
            "observed_churn_rate_pct": S.Rate(),
        },
    ),
    "s08_03_value_bands_churn": S.Profile({"value_band": "exposure_value"}, {**CHURN, "avg_arpu": S.Mean("arpu_8")}),
    "s08_04_value_contribution": S.Profile(
        {"value_band": "exposure_value"},
        {
            "customers": S.Count(),
            "value_proxy": S.Total("value"),
            "value_contribution_pct": S.TotalShare("value"),
        },
    ),
    "s08_05_churned_value_exposure": churned_value_exposure,
    "s08_06_churn_contribution": S.Profile(
        {"value_band": "exposure_value"},
        {
            "customers": S.Count(),
            "churned_customers": S.Churners(),
            "observed_churned_value_proxy": S.Total("value", churned_only=True),
            "churn_customer_contribution_pct": S.Contribution(),
            "churn_value_contribution_pct": S.TotalShare("value", churned_only=True),
        },
    ),
    "s08_07_pareto_deciles": pareto_deciles,
    "s08_08_high_value_share": high_value_share,
    "s08_09_high_value_churn": high_value_churn,
    "s08_10_high_value_declining_value": lambda df: _high_value_decline(
        df, "arpu", "arpu_change_pct", "avg_arpu_change_pct"
    ),
    "s08_11_high_value_declining_recharge": lambda df: _high_value_decline(
        df, "total_rech_amt", "recharge_change_pct", "avg_recharge_change_pct"
    ),
    "s08_12_value_x_recharge": _by_value_group("recharge_status", "recharge_status"),
    "s08_13_value_x_engagement": _by_value_group("engagement_group", "exposure_voice"),
    "s08_14_tenure_x_value": _by_value_group("tenure_band", "exposure_tenure", {"avg_arpu": S.Mean("arpu_8")}),
    "s08_15_value_x_temporal": _by_value_group("temporal_status", "decline_status"),
    "s08_16_scenario_exposure": scenario_exposure,
    "s08_17_value_signals": value_signals,
    "s08_18_quality_gate": lambda df: value_gate(df, "analytical_quality_gate"),
}
