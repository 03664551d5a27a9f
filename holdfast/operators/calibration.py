"""Probability calibration: sigmoid and isotonic fits, their comparison and effect on ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import rounded
from holdfast.operators.metrics import calibration_error, rank_metrics
from holdfast.operators.modelling import union_all
from holdfast.operators.ranking import average_rank_percent
from holdfast.operators.scoring import Sigmoid, clipped, logit
from holdfast.session import materialise

METHODS = ("uncalibrated", "sigmoid", "isotonic")


def _logit_fit(df: DataFrame, penalty_per_row: float) -> LogisticRegressionModel:
    rows = df.select("label", logit(F.col("score")).alias("z"))
    assembled = VectorAssembler(inputCols=["z"], outputCol="features").transform(rows)
    # two parameters: iterate until they stand still
    fit_ = LogisticRegression(labelCol="label", regParam=penalty_per_row, standardization=False, tol=1e-12, maxIter=500)
    return fit_.fit(assembled)


def fit_sigmoid(df: DataFrame) -> Sigmoid:
    """Platt fit of label on logit(score) with unit penalty; the result is two numbers."""
    model = _logit_fit(df, 1.0 / max(df.count(), 1))
    return Sigmoid(float(model.coefficients[0]), float(model.intercept))


def apply_sigmoid(df: DataFrame, sigmoid: Sigmoid) -> DataFrame:
    return df.withColumn("score", clipped(sigmoid.apply(F.col("score"))))


def fit_isotonic(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Non-decreasing fit of label on score; scores outside the fitted range take the end values.

    Equal scores are one weighted point. The library pools violators inside range partitions first, so
    that only the blocks that are left, far fewer than the points, meet in its last step.
    """
    points = df.groupBy("score").agg(F.avg("label").alias("rate"), F.count(F.lit(1)).cast("double").alias("weight"))
    model = IsotonicRegression(labelCol="rate", featuresCol="score", weightCol="weight", isotonic=True).fit(points)

    def apply(rows: DataFrame) -> DataFrame:
        return model.transform(rows).withColumn("score", clipped(F.col("prediction"))).drop("prediction")

    return apply


def fit(method: str, df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    if method == "sigmoid":
        sigmoid = fit_sigmoid(df)
        return lambda rows: apply_sigmoid(rows, sigmoid)
    if method == "isotonic":
        return fit_isotonic(df)
    return lambda rows: rows.withColumn("score", clipped(F.col("score")))


def slope_intercept(df: DataFrame) -> tuple[float, float]:
    """Calibration slope and intercept: an unpenalised logit fit; 1 and 0 when well calibrated."""
    model = _logit_fit(df, 0.0)
    return float(model.coefficients[0]), float(model.intercept)


def compare_methods(df: DataFrame, folds: int) -> DataFrame:
    """Each method fitted on the other folds, judged on the held-out one; best Brier score first."""
    held_out = []
    for fold in range(1, folds + 1):
        rest, out = df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)
        for method in METHODS:
            applied = fit(method, rest)(out)
            held_out.append(applied.select(F.lit(method).alias("model"), "fold", "id", "label", "score"))
    scores = materialise(union_all(held_out))
    keys = ["model", "fold"]
    results = rank_metrics(scores, keys).join(F.broadcast(calibration_error(scores, keys)), keys)
    order = Window.orderBy(F.asc("brier_mean"), F.asc("log_loss_mean"), F.asc("ece_mean"))
    shown = []
    for metric in ("brier_score", "log_loss", "ece", "pr_auc", "roc_auc"):
        name = metric.removesuffix("_score")
        shown += [F.avg(metric).alias(f"{name}_mean"), F.stddev_samp(metric).alias(f"{name}_std")]
    return (
        results.groupBy(F.col("model").alias("method"))
        .agg(*shown)
        .withColumn("selection_rank", F.row_number().over(order).cast("bigint"))
    )


def rank_preservation(scores: DataFrame, sigmoid: Sigmoid = Sigmoid()) -> DataFrame:
    """Spearman correlation of raw and calibrated scores: Pearson correlation of tie-averaged ranks."""
    both = materialise(
        scores.select("id", "score", rounded(sigmoid.apply(F.col("score")), 6).alias("calibrated"))
    )
    ranked = average_rank_percent(average_rank_percent(both, "score", "raw_rank"), "calibrated", "calibrated_rank")
    return ranked.agg(
        F.count(F.lit(1)).alias("customers"),
        rounded(F.corr("raw_rank", "calibrated_rank"), 6).alias("ranking_spearman_vs_uncalibrated"),
    )


def before_after(scores: DataFrame, sigmoid: Sigmoid = Sigmoid()) -> DataFrame:
    """Metrics of raw and calibrated scores of the same customers in one job."""
    raw, calibrated = F.col("score"), rounded(sigmoid.apply(F.col("score")), 6)
    long = materialise(
        scores.select(
            "id",
            "label",
            F.inline(
                F.array(
                    F.struct(F.lit("before_calibration").alias("stage"), raw.alias("score")),
                    F.struct(F.lit("after_calibration").alias("stage"), calibrated.alias("score")),
                )
            ),
        )
    )
    means = long.groupBy("stage").agg(
        rounded(F.avg("score"), 6).alias("mean_predicted_probability"),
        rounded(F.avg("label"), 6).alias("actual_churn_rate"),
    )
    return (
        rank_metrics(long, ["stage"])
        .join(F.broadcast(calibration_error(long, ["stage"])), "stage")
        .join(F.broadcast(means), "stage")
    )
