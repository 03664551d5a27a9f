"""Additive attribution of a linear score: weight x (value - development mean), in log-odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.quantiles import medians
from holdfast.operators.scoring import Scorecard, scored
from holdfast.operators.splitting import DEVELOPMENT, join_split
from holdfast.session import materialise

TOP_DRIVERS = 5
TOP_CUSTOMERS = 50
STRONG, MODERATE = 75.0, 60.0


def prepared(panel: DataFrame, card: Scorecard = Scorecard()) -> DataFrame:
    """(id, label, split, score, measures with missing as zero), stored once: later steps read it repeatedly."""
    rows = scored(panel, *[c for c in card.weights if c != "arpu_8"], card=card)
    zeroed = rows.select(
        "id", "label", "score", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in card.weights]
    )
    return materialise(join_split(zeroed))


def baseline(rows: DataFrame, card: Scorecard = Scorecard()) -> DataFrame:
    """One row: development mean of every measure."""
    means = [F.avg(c).alias(f"_b_{c}") for c in card.weights]
    return rows.filter(F.col("split") == DEVELOPMENT).groupBy(F.lit(1).alias("_one")).agg(*means)


def contributions(rows: DataFrame, card: Scorecard = Scorecard()) -> DataFrame:
    """Long table (id, feature, value, contribution): a projection, no shuffle."""
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(baseline(rows, card)), "_one")
    entries = ", ".join(
        f"struct('{c}' AS feature, {c} AS value, ({w}D) * ({c} - _b_{c}) AS contribution)"
        for c, w in card.weights.items()
    )
    return joined.selectExpr("id", "score", f"inline(array({entries}))")


def attribution_table(rows: DataFrame, card: Scorecard = Scorecard()) -> DataFrame:
    return contributions(rows, card).select(
        "id", "feature", "value", rounded("contribution", 6).alias("contribution")
    )


def additivity(rows: DataFrame, card: Scorecard = Scorecard(), tolerance: float = 1e-5) -> DataFrame:
    """Contributions plus the mean score must give each customer's log-odds."""
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(baseline(rows, card)), "_one")
    base = F.expr(" + ".join([f"{card.intercept}D"] + [f"({w}D) * _b_{c}" for c, w in card.weights.items()]))
    parts = F.expr(" + ".join(f"({w}D) * ({c} - _b_{c})" for c, w in card.weights.items()))
    gap = F.abs(base + parts - F.expr(card.linear()))
    return joined.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(gap > tolerance).alias("violations"),
    )


def global_importance(rows: DataFrame, card: Scorecard = Scorecard()) -> DataFrame:
    return importance_of(contributions(rows, card))


def importance_of(long: DataFrame) -> DataFrame:
    groups = long.groupBy("feature").agg(
        rounded(F.avg(F.abs("contribution")), 6).alias("mean_abs_contribution")
    )
    order = Window.orderBy(F.desc("mean_abs_contribution"), "feature")
    return groups.withColumn("rank", F.row_number().over(order).cast("bigint"))


def direction(rows: DataFrame, card: Scorecard = Scorecard()) -> DataFrame:
    """How consistently each feature pushes the score up or down."""
    return direction_of(contributions(rows, card), medians(rows, list(card.weights)))


def direction_of(long: DataFrame, middle: DataFrame) -> DataFrame:
    """``middle`` has one row (feature, median) for each feature."""
    x = F.col("contribution")
    groups = long.groupBy("feature").agg(
        F.avg(x).alias("mean"),
        F.avg(F.abs(x)).alias("size"),
        F.count_if(x > 0).alias("up"),
        F.count_if(x < 0).alias("down"),
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("v"),
    )
    moved = F.col("up") + F.col("down")
    up, down = (F.coalesce(ratio(F.col(c) * 100.0, moved), F.lit(0.0)) for c in ("up", "down"))
    consistency = F.greatest(up, down)
    label = (
        F.when(moved == 0, "No contribution")
        .when(consistency >= STRONG, "Strongly consistent")
        .when(consistency >= MODERATE, "Moderately consistent")
        .otherwise("Mixed")
    )
    trend = (
        F.when(F.col("mean") > 1e-12, "Positive average contribution")
        .when(F.col("mean") < -1e-12, "Negative average contribution")
        .otherwise("Near-neutral average contribution")
    )
    return groups.join(F.broadcast(middle), "feature").select(
        "feature",
        rounded("mean", 6).alias("mean_contribution"),
        rounded("size", 6).alias("mean_abs_contribution"),
        rounded(up, 6).alias("positive_pct_nonzero"),
        rounded(down, 6).alias("negative_pct_nonzero"),
        rounded(ratio((F.col("n") - moved) * 100.0, "n"), 6).alias("zero_pct"),
        rounded(consistency, 6).alias("direction_consistency_pct"),
        label.alias("direction_consistency_label"),
        rounded("v", 4).alias("mean_feature_value"),
        rounded("median", 4).alias("median_feature_value"),
        trend.alias("overall_direction"),
    )


def _ranked_drivers(long: DataFrame) -> DataFrame:
    """Drivers of each customer by size inside each sign; a customer has one row per feature."""
    x = rounded("contribution", 6)
    signed = long.select("id", "score", "feature", "value", x.alias("contribution")).filter("contribution <> 0")
    side = F.when(F.col("contribution") > 0, "positive").otherwise("negative")
    order = Window.partitionBy("id", "side").orderBy(F.desc(F.abs("contribution")), "feature")
    return signed.withColumn("side", side).withColumn("place", F.row_number().over(order))


def top_drivers(rows: DataFrame, card: Scorecard = Scorecard(), k: int = TOP_DRIVERS) -> DataFrame:
    """Per customer the k largest positive and negative drivers, padded with NULL: a projection, no shuffle."""
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(baseline(rows, card)), "_one")
    terms = []
    for c, w in card.weights.items():
        x = rounded(F.expr(f"({w}D) * ({c} - _b_{c})"), 6)
        terms.append(F.struct((-F.abs(x)).alias("size"), F.lit(c).alias("feature"), x.alias("contribution")))
    return _slots(joined.select("id", F.array_sort(F.array(*terms)).alias("_d")), k)


def _slots(sorted_: DataFrame, k: int) -> DataFrame:
    sides = sorted_.select("id", *[F.expr(f"filter(_d, e -> e.contribution {op} 0)").alias(side) for side, op in SIDES.items()])
    slots = []
    for side in SIDES:
        for i in range(1, k + 1):
            slot = F.get(side, F.lit(i - 1))
            slots += [slot["feature"].alias(f"{side}_driver_{i}"), slot["contribution"].alias(f"{side}_driver_{i}_contribution")]
    return sides.select("id", *slots)


SIDES = {"positive": ">", "negative": "<"}


def top_risk_profiles(rows: DataFrame, card: Scorecard = Scorecard(), k: int = TOP_CUSTOMERS) -> DataFrame:
    """The k highest-scored customers with their drivers written out."""
    top = rows.orderBy(F.desc("score"), "id").limit(k)
    base = baseline(rows, card)
    joined = materialise(top).withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")
    entries = ", ".join(
        f"struct('{c}' AS feature, {c} AS value, ({w}D) * ({c} - _b_{c}) AS contribution)"
        for c, w in card.weights.items()
    )
    return risk_profiles_of(joined.selectExpr("id", "score", f"inline(array({entries}))"))


def drivers_of(long: DataFrame, k: int = TOP_DRIVERS) -> DataFrame:
    """``top_drivers`` of a long table; one group of as many rows as features for each customer."""
    x = rounded("contribution", 6)
    entry = F.struct((-F.abs(x)).alias("size"), "feature", x.alias("contribution"))
    return _slots(long.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("_d")), k)


def risk_profiles_of(long: DataFrame) -> DataFrame:
    """Drivers of the customers of a long table written out."""
    ranked = _ranked_drivers(long)
    text = F.concat_ws("", F.col("place").cast("string"), F.lit(". "), F.col("feature"))
    ranked = ranked.filter(F.col("place") <= TOP_DRIVERS).withColumn("text", text)

    def joined_text(side: str):
        picked = F.collect_list(F.when(F.col("side") == side, F.struct("place", "text")))
        return F.array_join(F.transform(F.array_sort(picked), lambda s: s["text"]), " | ")

    return ranked.groupBy("id", "score").agg(
        joined_text("positive").alias("top_positive_drivers"),
        joined_text("negative").alias("top_negative_drivers"),
    )
