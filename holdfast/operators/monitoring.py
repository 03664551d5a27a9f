"""Comparison of two populations: feature drift and score monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.metrics import LOSS_CLIP, calibration_error
from holdfast.operators.quantiles import exact_quantiles, long_values
from holdfast.operators.scoring import PRIMARY_THRESHOLD, VERY_HIGH_THRESHOLD
from holdfast.session import materialise

DECILES = {f"q{i}": i / 10 for i in range(1, 10)}
SHARE_FLOOR = 1e-6
"""A bin's share is at least this, so that an empty bin leaves the index finite."""


def feature_drift(df: DataFrame, columns: list[str], population: str, reference: str, current: str) -> DataFrame:
    """Population stability index and mean, median and missing-rate change per feature.

    Bins are the exact deciles of the reference population. The bin edges (nine numbers per
    feature) are the only thing broadcast. A feature that a population has no value of keeps its row,
    without an index.
    """
    rows = materialise(df.filter(F.col(population).isin(reference, current)).select(population, *columns))
    edges = exact_quantiles(rows.filter(F.col(population) == reference), columns, DECILES)
    long = long_values(rows, columns, [population]).join(F.broadcast(edges), "feature", "left")
    bin_of = F.lit(0)
    for q in DECILES:
        bin_of = bin_of + F.when(F.col("value") > F.col(q), 1).otherwise(0)
    is_ref = F.col(population) == reference
    counts = long.groupBy("feature", bin_of.alias("bin")).agg(
        F.count_if(is_ref).alias("r"), F.count_if(~is_ref).alias("c")
    )
    totals = long.groupBy("feature").agg(
        F.count_if(is_ref).alias("all_r"),
        F.count_if(~is_ref).alias("all_c"),
        F.avg(F.when(is_ref, F.col("value"))).alias("mean_r"),
        F.avg(F.when(~is_ref, F.col("value"))).alias("mean_c"),
    )

    def share(part: str, whole: str) -> Column:
        """Share of a bin, NULL (and with it the index) when the population has no value at all."""
        return F.when(F.col(whole) > 0, F.greatest(ratio(part, whole), F.lit(SHARE_FLOOR)))

    share_r, share_c = share("r", "all_r"), share("c", "all_c")
    psi = counts.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.sum((share_c - share_r) * F.ln(share_c / share_r)).alias("psi")
    )
    sizes = rows.groupBy(F.lit(1).alias("_one")).agg(
        F.count_if(is_ref).alias("rows_r"), F.count_if(~is_ref).alias("rows_c")
    )
    middle = exact_quantiles(rows, columns, {"median": 0.5}, [population])
    wide = middle.groupBy("feature").agg(
        F.max(F.when(is_ref, F.col("median"))).alias("median_r"),
        F.max(F.when(~is_ref, F.col("median"))).alias("median_c"),
    )
    names = rows.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    out = (
        names.join(totals, "feature", "left")
        .fillna(0, ["all_r", "all_c"])
        .join(F.broadcast(psi), "feature", "left")
        .join(F.broadcast(wide), "feature", "left")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(sizes), "_one")
    )
    missing_r = ratio((F.col("rows_r") - F.col("all_r")) * 100.0, "rows_r")
    missing_c = ratio((F.col("rows_c") - F.col("all_c")) * 100.0, "rows_c")
    return out.select(
        "feature",
        rounded("psi", 6).alias("psi"),
        rounded("mean_r", 4).alias("reference_mean"),
        rounded("mean_c", 4).alias("current_mean"),
        rounded("median_r", 4).alias("reference_median"),
        rounded("median_c", 4).alias("current_median"),
        rounded(missing_r, 4).alias("reference_missing_pct"),
        rounded(missing_c, 4).alias("current_missing_pct"),
    )


def score_monitor(scores: DataFrame, population: str, primary: float = PRIMARY_THRESHOLD) -> DataFrame:
    """Score level, threshold population, calibration and exposure per population (run, split, …)."""
    rows = materialise(scores.select(population, "id", "label", "score", "value"))
    p = F.col("score")
    safe = F.greatest(F.least(p, F.lit(1.0 - LOSS_CLIP)), F.lit(LOSS_CLIP))
    loss = F.when(F.col("label") == 1, -F.ln(safe)).otherwise(-F.ln(F.lit(1.0) - safe))
    sums = rows.groupBy(population).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("score").alias("p"),
        F.avg("label").alias("y"),
        F.count_if(p >= primary).alias("above"),
        F.count_if(p >= VERY_HIGH_THRESHOLD).alias("very_high"),
        F.avg((p - F.col("label")) * (p - F.col("label"))).alias("brier"),
        F.avg(loss).alias("loss"),
        F.sum(p * F.col("value")).alias("exposure"),
    )
    middle = exact_quantiles(rows, ["score"], {"median": 0.5}, [population]).select(population, "median")
    out = sums.join(F.broadcast(middle), population).join(
        F.broadcast(calibration_error(rows, [population])), population
    )
    return out.select(
        population,
        "customers",
        rounded("p", 6).alias("mean_probability"),
        rounded("median", 6).alias("median_probability"),
        rounded("y", 6).alias("observed_churn_rate"),
        rounded(ratio(F.col("above") * 100.0, "customers"), 6).alias("above_threshold_pct"),
        rounded(ratio(F.col("very_high") * 100.0, "customers"), 6).alias("very_high_pct"),
        rounded("brier", 6).alias("brier_score"),
        rounded("loss", 6).alias("log_loss"),
        "ece",
        rounded("exposure", 4).alias("monthly_exposure"),
    )
