"""Classification metrics over (label, score) tables, all from counts per distinct score.

Rows are reduced to one line per (group, score) first. Running counts over those lines give exact
ROC-AUC with ties and step-wise average precision for any number of models and folds at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.ranking import global_rank, grouped_prefix_sums

LOSS_CLIP = 1e-15
TOP_SHARES = (0.05, 0.10, 0.20)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def from_counts(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Every metric that four counts define; undefined precision, recall and F1 are 0."""
    n = tp + tn + fp + fn
    precision, recall = or_zero(ratio(tp, tp + fp)), or_zero(ratio(tp, tp + fn))
    rate = ratio(tp + fp, n)
    return {
        "accuracy": rounded(ratio(tp + tn, n), 6),
        "precision": rounded(precision, 6),
        "recall": rounded(recall, 6),
        "f1": rounded(or_zero(ratio(2.0 * precision * recall, precision + recall)), 6),
        "targeting_rate": rounded(rate, 6),
        "churn_capture": rounded(recall, 6),
        "lift": rounded(ratio(recall, rate), 6),
        "true_negatives": tn,
        "false_positives": fp,
        "false_negatives": fn,
        "true_positives": tp,
        "predicted_churn_count": tp + fp,
        "actual_churn_count": tp + fn,
        "missed_churn_rate": rounded(ratio(fn, n), 6),
        "actual_churn_rate": rounded(ratio(tp + fn, n), 6),
    }


def confusion(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and derived metrics at one threshold, per group."""
    hit, churn = F.col("score") >= threshold, F.col("label") == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(hit & churn).alias("tp"),
        F.count_if(~hit & ~churn).alias("tn"),
        F.count_if(hit & ~churn).alias("fp"),
        F.count_if(~hit & churn).alias("fn"),
    )
    shown = from_counts(*(F.col(c) for c in ("tp", "tn", "fp", "fn")))
    return counts.select(
        *(by or []), F.lit(float(threshold)).alias("threshold"), *[c.alias(k) for k, c in shown.items()]
    )


def score_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Customers and churners per distinct score: the only full-size aggregation."""
    return df.groupBy(*(by or []), "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("pos")
    )


def cumulated(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score counts with running counts from the highest score down."""
    return grouped_prefix_sums(score_counts(df, by), by or [], [F.col("score").desc()], ["n", "pos"])


def rank_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC, average precision, log loss and Brier score per group."""
    n, pos, score = F.col("n"), F.col("pos"), F.col("score")
    neg, above = n - pos, F.col("cum_pos") - pos
    p = F.greatest(F.least(score, F.lit(1.0 - LOSS_CLIP)), F.lit(LOSS_CLIP))
    sums = cumulated(df, by).groupBy(*(by or [])).agg(
        F.sum(n).alias("rows"),
        F.sum(pos).alias("churners"),
        F.sum(neg * (above + pos / 2.0)).alias("pairs"),
        F.sum(pos * (F.col("cum_pos") / F.col("cum_n"))).alias("ap"),
        F.sum(pos * -F.ln(p) + neg * -F.ln(F.lit(1.0) - p)).alias("loss"),
        F.sum(pos * (F.lit(1.0) - score) * (F.lit(1.0) - score) + neg * score * score).alias("brier"),
    )
    negatives = F.col("rows") - F.col("churners")
    return sums.select(
        *(by or []),
        "rows",
        "churners",
        rounded(ratio("pairs", F.col("churners") * negatives), 6).alias("roc_auc"),
        rounded(ratio("ap", "churners"), 6).alias("pr_auc"),
        rounded(ratio("loss", "rows"), 6).alias("log_loss"),
        rounded(ratio("brier", "rows"), 6).alias("brier_score"),
    )


def curves(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    negatives = F.col("all_n") - F.col("all_pos")
    return cumulated(df, by).select(
        *(by or []),
        "score",
        rounded(ratio("cum_pos", "all_pos"), 6).alias("recall"),
        rounded(ratio(F.col("cum_n") - F.col("cum_pos"), negatives), 6).alias("false_positive_rate"),
        rounded(ratio("cum_pos", "cum_n"), 6).alias("precision"),
    )


def ranked_by_score(df: DataFrame) -> DataFrame:
    """Customers ranked by score, highest first, ties by id."""
    return global_rank(df.select("id", "label", "score"), [F.col("score").desc(), F.col("id").asc()])


def top_share_metrics(df: DataFrame, shares: tuple[float, ...] = TOP_SHARES) -> DataFrame:
    """Churn capture and lift of the highest-scored ceil(n * share) customers, all shares in one pass."""
    k = {s: F.greatest(F.ceil(F.col("rows_total") * F.lit(s)), F.lit(1)) for s in shares}
    churn = F.col("label") == 1
    sums = ranked_by_score(df).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(churn).alias("churners"),
        *[F.max(k[s]).alias(f"k{i}") for i, s in enumerate(shares)],
        *[F.count_if(churn & (F.col("rank") <= k[s])).alias(f"hit{i}") for i, s in enumerate(shares)],
    )
    rows = [
        F.struct(
            F.lit(s).alias("top_share"), F.col(f"k{i}").alias("selected"), F.col(f"hit{i}").alias("captured")
        )
        for i, s in enumerate(shares)
    ]
    return sums.select("n", "churners", F.inline(F.array(*rows))).select(
        "top_share",
        "selected",
        "captured",
        rounded(ratio("captured", "churners"), 6).alias("churn_capture"),
        rounded(ratio(ratio("captured", "selected"), ratio("churners", "n")), 6).alias("lift"),
    )


def score_bin(bins: int = 10) -> Column:
    return F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int") + 1


def calibration_error(df: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, per group."""
    per_bin = df.groupBy(*(by or []), score_bin(bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("conf"), F.avg("label").alias("acc")
    )
    return per_bin.groupBy(*(by or [])).agg(
        rounded(
            ratio(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))), F.sum("n")), 6
        ).alias("ece")
    )


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """Predicted against observed rate per bin; bins without customers are shown with 0 rows."""
    filled = df.groupBy(score_bin(bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("conf"), F.avg("label").alias("acc")
    )
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(filled), "bin", "left").select(
        "bin",
        rounded((F.col("bin") - 1) / float(bins), 6).alias("bin_lower"),
        rounded(F.col("bin") / float(bins), 6).alias("bin_upper"),
        F.coalesce("n", F.lit(0)).alias("sample_count"),
        rounded("conf", 6).alias("mean_predicted_probability"),
        rounded("acc", 6).alias("observed_churn_rate"),
    )
