"""Comparison of models from a long table (model, fold, id, label, score).

The table may hold out-of-fold scores of trained models or of any other scores; every report is
computed for all models and folds in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.metrics import confusion, rank_metrics
from holdfast.operators.ranking import grouped_rank
from holdfast.session import materialise

TOPS = (5, 10, 20)
SUMMARY_METRICS = (
    "pr_auc",
    "roc_auc",
    "precision",
    "recall",
    "f1",
    "log_loss",
    "brier_score",
    "predicted_churn_rate",
    "top_10_capture",
    "top_10_lift",
)
CLOSE = 0.002
"""Models within this PR-AUC of the best count as equally good."""


def top_table(scores: DataFrame, by: list[str]) -> DataFrame:
    """Capture and lift of the top 5, 10 and 20 % per group, ties by id."""
    ranked = grouped_rank(
        scores.select(*by, "id", "label", "score"), by, [F.col("score").desc(), F.col("id").asc()], "r", "size"
    )
    aggs = [F.sum("label").alias("pos"), F.max("size").alias("size")]
    for t in TOPS:
        k = F.greatest(F.ceil(F.col("size") * t / 100.0), F.lit(1))
        aggs += [
            F.max(k).alias(f"k{t}"),
            F.count_if((F.col("r") <= k) & (F.col("label") == 1)).alias(f"hit{t}"),
        ]
    sums = ranked.groupBy(*by).agg(*aggs)
    out = []
    for t in TOPS:
        out.append(rounded(ratio(f"hit{t}", "pos"), 6).alias(f"top_{t}_capture"))
        lift = ratio(ratio(f"hit{t}", f"k{t}"), ratio("pos", "size"))
        out.append(rounded(lift, 6).alias(f"top_{t}_lift"))
    return sums.select(*by, *out)


def fold_results(scores: DataFrame, by: tuple[str, ...] = ("model", "fold")) -> DataFrame:
    """All metrics per model and fold."""
    keys = list(by)
    rows = materialise(scores.select(*keys, "id", "label", "score"))
    counts = confusion(rows, 0.5, keys).select(
        *keys,
        "precision",
        "recall",
        "f1",
        "accuracy",
        F.col("targeting_rate").alias("predicted_churn_rate"),
        F.col("actual_churn_rate").alias("fold_churn_rate"),
    )
    # one row per (model, fold) on each side
    return rank_metrics(rows, keys).join(F.broadcast(counts), keys).join(F.broadcast(top_table(rows, keys)), keys)


def model_summary(folds: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of every metric, and the PR-AUC rank."""
    aggs: list[Column] = []
    for m in SUMMARY_METRICS:
        aggs += [
            rounded(F.avg(m), 6).alias(f"{m}_mean"),
            rounded(F.stddev_samp(m), 6).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    place = F.row_number().over(Window.orderBy(F.desc("pr_auc_mean"), "model")).cast("bigint")
    return (
        folds.groupBy("model")
        .agg(F.count(F.lit(1)).alias("folds"), *aggs)
        .withColumn("pr_auc_rank", place)
    )


def fold_ranking(folds: DataFrame) -> DataFrame:
    """Rank of the models inside each fold."""
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("pr_auc"), "model"))
    return folds.select("fold", "model", "pr_auc", place.cast("bigint").alias("pr_auc_rank"))


def pairwise_models(folds: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Fold-by-fold PR-AUC difference of model pairs, from one pivoted table."""
    models = sorted({m for pair in pairs for m in pair})
    wide = folds.groupBy("fold").pivot("model", models).agg(F.first("pr_auc"))
    entries = [
        F.struct(
            F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")
        )
        for a, b in pairs
    ]
    gap = F.col("a") - F.col("b")
    return (
        wide.select(F.inline(F.array(*entries)))
        .groupBy("model_a", "model_b")
        .agg(
            rounded(F.avg("a"), 6).alias("mean_pr_auc_a"),
            rounded(F.avg("b"), 6).alias("mean_pr_auc_b"),
            rounded(F.avg(gap), 6).alias("mean_pr_auc_difference"),
            rounded(F.stddev_samp(gap), 6).alias("std_pr_auc_difference"),
            F.count_if(gap > 0).alias("folds_model_a_higher"),
            F.count_if(gap < 0).alias("folds_model_b_higher"),
            F.count_if(gap == 0).alias("folds_equal"),
        )
    )


def holdout_comparison(holdout: DataFrame, summary: DataFrame) -> DataFrame:
    """Held-out metrics next to the cross-validated ones: gap, rank and closeness to the best."""
    cv = summary.select("model", F.col("pr_auc_mean").alias("cv_pr_auc"))
    rows = holdout.join(F.broadcast(cv), "model")
    order = Window.orderBy(F.desc("pr_auc"), "model")
    best = F.max("pr_auc").over(Window.partitionBy())
    gap = F.col("pr_auc") - F.col("cv_pr_auc")
    return rows.select(
        "model",
        "cv_pr_auc",
        F.col("pr_auc").alias("validation_pr_auc"),
        F.col("roc_auc").alias("validation_roc_auc"),
        F.col("precision").alias("precision_at_0_50"),
        F.col("recall").alias("recall_at_0_50"),
        F.col("f1").alias("f1_at_0_50"),
        "log_loss",
        "brier_score",
        "top_10_capture",
        "top_10_lift",
        rounded(gap, 6).alias("validation_minus_cv_pr_auc"),
        rounded(F.abs(gap), 6).alias("absolute_cv_validation_gap"),
        F.row_number().over(order).cast("bigint").alias("validation_rank"),
        (best - F.col("pr_auc") <= CLOSE + 1e-9).alias("within_pr_auc_0_002_of_best"),
    )


def canonical_name(model: Column) -> Column:
    """Upper-case words joined by underscores."""
    return F.upper(F.regexp_replace(F.trim(F.regexp_replace(model, r"[^A-Za-z0-9]+", " ")), r" +", "_"))


def final_model(comparison: DataFrame) -> DataFrame:
    """Scorecard of all models; the first by held-out PR-AUC is selected."""
    best = F.max("validation_pr_auc").over(Window.partitionBy())
    return comparison.select(
        canonical_name(F.col("model")).alias("model"),
        "validation_rank",
        "validation_pr_auc",
        rounded(best - F.col("validation_pr_auc"), 6).alias("pr_auc_gap_from_best"),
        "within_pr_auc_0_002_of_best",
        "validation_roc_auc",
        "top_10_capture",
        "cv_pr_auc",
        "absolute_cv_validation_gap",
        F.when(F.col("validation_rank") == 1, "SELECTED").otherwise("NOT SELECTED").alias("final_selection"),
    )


def tuning_table(validation: DataFrame, training: DataFrame, families: dict[str, str], baselines: dict[str, str]) -> DataFrame:
    """Candidates by mean PR-AUC inside their family, against the family's baseline candidate.

    ``validation`` and ``training`` are fold results whose model column holds candidate names;
    ``families`` maps candidates to families, ``baselines`` families to candidates.
    """
    family = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])[F.col("model")]
    seen = training.groupBy("model").agg(F.avg("pr_auc").alias("train"))
    groups = validation.groupBy("model").agg(
        F.avg("pr_auc").alias("mean"),
        F.stddev_samp("pr_auc").alias("std"),
        F.avg("roc_auc").alias("roc"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.avg("top_10_capture").alias("capture"),
        F.avg("top_10_lift").alias("lift"),
    )
    rows = groups.join(F.broadcast(seen), "model").withColumns(
        {"family": family, "gap": F.col("train") - F.col("mean")}
    )
    whole = Window.partitionBy("family")
    is_base = F.col("model").isin(*baselines.values())
    base = F.max(F.when(is_base, F.col("mean"))).over(whole)
    order = whole.orderBy(
        F.desc("mean"), F.asc_nulls_last("std"), F.desc("capture"), F.asc("gap"), F.asc("model")
    )
    return rows.select(
        F.col("family").alias("model"),
        F.col("model").alias("candidate_id"),
        rounded("mean", 6).alias("mean_pr_auc"),
        rounded("std", 6).alias("std_pr_auc"),
        rounded("roc", 6).alias("mean_roc_auc"),
        rounded("precision", 6).alias("mean_precision"),
        rounded("recall", 6).alias("mean_recall"),
        rounded("f1", 6).alias("mean_f1"),
        rounded("capture", 6).alias("mean_top10_capture"),
        rounded("lift", 6).alias("mean_top10_lift"),
        rounded("train", 6).alias("mean_train_pr_auc"),
        rounded("gap", 6).alias("generalization_gap"),
        rounded(base, 6).alias("baseline_cv_pr_auc"),
        rounded(F.col("mean") - base, 6).alias("pr_auc_improvement"),
        rounded(ratio((F.col("mean") - base) * 100.0, base), 6).alias("pr_auc_improvement_pct"),
        F.row_number().over(order).cast("bigint").alias("model_rank"),
    )


def tuning_selection(table: DataFrame) -> DataFrame:
    """Best candidate per family, whether tuning helped, and the overall order."""
    best = table.filter(F.col("model_rank") == 1)
    gain = F.col("pr_auc_improvement")
    order = Window.orderBy(
        F.desc("mean_pr_auc"), F.asc_nulls_last("std_pr_auc"), F.desc("mean_top10_capture"), F.asc("generalization_gap")
    )
    return best.select(
        "model",
        "baseline_cv_pr_auc",
        F.col("candidate_id").alias("best_candidate"),
        F.col("mean_pr_auc").alias("best_cv_pr_auc"),
        "pr_auc_improvement",
        "pr_auc_improvement_pct",
        F.col("mean_top10_capture").alias("top10_capture"),
        "generalization_gap",
        F.when(gain > 0, "IMPROVED").when(gain < 0, "WORSE").otherwise("UNCHANGED").alias("tuning_status"),
        F.row_number().over(order).cast("bigint").alias("overall_rank"),
    )
