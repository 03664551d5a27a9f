"""Customer risk table, its distribution, gate and intervention tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.gate import check_rows
from holdfast.operators.quantiles import medians
from holdfast.operators.ranking import average_rank_percent, global_rank
from holdfast.operators.scoring import LEVELS, PRIMARY_THRESHOLD, risk_level
from holdfast.operators.splitting import DEVELOPMENT, with_split
from holdfast.operators.thresholds import risk_band
from holdfast.session import materialise
from holdfast.specs import EXPECTED_ROWS

# Scoring population names.
POPULATIONS = ("Development OOF", "Validation")
RISK_SCHEMA = {
    "risk_rank": "bigint",
    "risk_percentile": "double",
    "id": "bigint",
    "calibrated_churn_probability": "double",
    "risk_score": "double",
    "risk_level": "string",
    "primary_threshold": "double",
    "above_primary_threshold": "boolean",
    "scoring_population": "string",
    "actual_churn": "int",
}
RISK_COLUMNS = tuple(RISK_SCHEMA)


def risk_rows(scores: DataFrame, primary: float = PRIMARY_THRESHOLD) -> DataFrame:
    """Score, level and threshold flag per customer; no ranks, so no sort."""
    p = F.col("score")
    return scores.select(
        "id",
        p.alias("calibrated_churn_probability"),
        rounded(p * 100.0, 4).alias("risk_score"),
        risk_level(p, primary).alias("risk_level"),
        F.lit(primary).alias("primary_threshold"),
        (p >= primary).alias("above_primary_threshold"),
        F.col("label").alias("actual_churn"),
        *[c for c in scores.columns if c not in ("id", "label", "score")],
    )


def risk_table(scores: DataFrame, primary: float = PRIMARY_THRESHOLD) -> DataFrame:
    """Ranked risk table: highest probability first, ties by id, tie-averaged percentile.

    ``scores`` holds id, label, score and may hold the split each customer was scored in.
    """
    split = scores if "split" in scores.columns else with_split(scores.select("id", "label", "score"))
    rows = risk_rows(split, primary).withColumn(
        "scoring_population", F.when(F.col("split") == DEVELOPMENT, POPULATIONS[0]).otherwise(POPULATIONS[1])
    )
    ranked = global_rank(
        rows, [F.col("calibrated_churn_probability").desc(), F.col("id").asc()], "risk_rank", "_n"
    )
    percentiles = average_rank_percent(ranked, "calibrated_churn_probability", "risk_percentile")
    return percentiles.withColumn("risk_percentile", rounded("risk_percentile", 6)).select(*RISK_COLUMNS)


def top_risk(scores: DataFrame, k: int = 100, primary: float = PRIMARY_THRESHOLD) -> DataFrame:
    """The k customers at highest risk: a top-k, not a full sort."""
    order = [F.desc("calibrated_churn_probability"), F.asc("id")]
    return (
        risk_rows(scores.select("id", "label", "score"), primary)
        .orderBy(*order)
        .limit(k)
        .select("id", "calibrated_churn_probability", "risk_score", "risk_level", "actual_churn")
    )


def risk_distribution(scores: DataFrame, primary: float = PRIMARY_THRESHOLD) -> DataFrame:
    rows = materialise(
        scores.select("id", "label", "score", risk_level(F.col("score"), primary).alias("risk_level"))
    )
    whole = Window.partitionBy()
    groups = rows.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("score").alias("p"),
        F.sum("label").alias("actual_churn_count"),
    )
    middle = medians(rows, ["score"], ["risk_level"]).select("risk_level", "median")
    shown = groups.join(F.broadcast(middle), "risk_level", "left")
    return shown.select(
        "risk_level",
        "customer_count",
        rounded(ratio("customer_count", F.sum("customer_count").over(whole)), 6).alias("customer_share"),
        rounded("p", 6).alias("mean_churn_probability"),
        rounded("median", 6).alias("median_churn_probability"),
        "actual_churn_count",
        rounded(ratio("actual_churn_count", "customer_count"), 6).alias("actual_churn_rate"),
        rounded(
            F.coalesce(ratio("actual_churn_count", F.sum("actual_churn_count").over(whole)), F.lit(0.0)), 6
        ).alias("actual_churn_capture_share"),
    )


def _all(cond: Column) -> Column:
    return F.count_if(~F.coalesce(cond, F.lit(False))) == 0


def risk_gate(table: DataFrame, expected_rows: int = EXPECTED_ROWS, primary: float = PRIMARY_THRESHOLD) -> DataFrame:
    """Data checks of a risk table. Order is checked by pairing each rank with the next one."""
    schema_holds = table.dtypes == list(RISK_SCHEMA.items())
    table = materialise(table.select(*RISK_COLUMNS))
    nxt = table.select(
        (F.col("risk_rank") - 1).alias("risk_rank"), F.col("calibrated_churn_probability").alias("next_p")
    )
    rows = table.join(nxt, "risk_rank", "left")
    p, n = F.col("calibrated_churn_probability"), F.count(F.lit(1))
    level = F.col("risk_level")
    checks = {  # fixed values: check names
        "Customer universe": n == expected_rows,
        "Unique customer IDs": F.count_distinct("id") == n,
        "Missing customer IDs": _all(F.col("id").isNotNull()),
        "Calibrated probabilities": _all(p.between(0.0, 1.0)),
        "Risk scores": _all(F.abs(F.col("risk_score") - p * 100.0) <= 1e-4),
        "Risk percentiles": _all(F.col("risk_percentile").between(0.0, 100.0)),
        "Risk levels": _all(level.isin(*LEVELS)),
        "Risk classification completeness": _all(level.isNotNull()),
        "Primary threshold": _all(F.col("primary_threshold") == primary),
        "Threshold logic": _all(F.col("above_primary_threshold") == (p >= primary)),
        "Risk classification logic": _all(level == risk_level(p, primary)),
        "Risk ranking": _all(F.col("next_p").isNull() | (p >= F.col("next_p"))),
        "Risk rank integrity": (F.min("risk_rank") == 1)
        & (F.max("risk_rank") == n)
        & (F.count_distinct("risk_rank") == n),
        "Development population": F.count_if(F.col("scoring_population") == POPULATIONS[0]) > 0,
        "Validation population": F.count_if(F.col("scoring_population") == POPULATIONS[1]) > 0,
        "Scoring population completeness": _all(F.col("scoring_population").isin(*POPULATIONS)),
        "Actual churn outcome": _all(F.col("actual_churn").isin(0, 1)),
        "Output schema": F.lit(schema_holds) & (n >= 0),
    }
    return check_rows(rows, checks)


# Intervention tiers.
TIERS = (
    "Tier 1 — Priority Retention",
    "Tier 2 — Targeted Retention",
    "Tier 3 — Proactive Engagement",
    "Tier 4 — Monitor",
)


def intervention_tiers(scores: DataFrame, high_value_percentile: float = 75.0) -> DataFrame:
    """Risk bands crossed with high value (value percentile above 75) into four tiers, summed up."""
    ranked = average_rank_percent(
        materialise(scores.select("id", "label", "score", "value")), "value", "value_percentile"
    )
    band, valuable = risk_band(F.col("score")), F.col("value_percentile") > high_value_percentile
    urgent = band.isin("High", "Very High")
    tier = (
        F.when(urgent & valuable, TIERS[0])
        .when(urgent, TIERS[1])
        .when((band == "Medium") & valuable, TIERS[2])
        .otherwise(TIERS[3])
    )
    groups = ranked.groupBy(tier.alias("intervention_tier")).agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("score").alias("p"),
        F.avg("label").alias("rate"),
        F.sum("value").alias("v"),
        F.sum(F.col("score") * F.col("value")).alias("e"),
        F.avg(F.col("score") * F.col("value_percentile") / 100.0).alias("priority"),
    )
    return groups.select(
        "intervention_tier",
        "customer_count",
        rounded(ratio("customer_count", F.sum("customer_count").over(Window.partitionBy())), 6).alias(
            "customer_share"
        ),
        rounded("p", 6).alias("mean_churn_probability"),
        rounded("rate", 6).alias("actual_churn_rate"),
        rounded("v", 4).alias("total_customer_value"),
        rounded("e", 4).alias("potential_revenue_exposure"),
        rounded("priority", 6).alias("mean_priority"),
    )
