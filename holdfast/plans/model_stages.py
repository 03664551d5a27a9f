"""From a customer panel to features, selection, models, calibration and attribution."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import rounded
from holdfast.operators import (
    attribution,
    calibration,
    evaluation,
    features,
    missingness,
    modelling,
    nearest_information,
    selection,
    splitting,
)
from holdfast.operators.modelling import MODEL_FEATURES
from holdfast.operators.scoring import Scorecard, scored, with_score
from holdfast.plans import selection_chain, trained
from holdfast.session import materialise
from holdfast.sources.contract import contract_checks
from holdfast.sources.panel import FIXTURE_CALENDAR

CARDS = {
    "Blend card": Scorecard(),
    "Recharge card": Scorecard(0.6, {"total_rech_num_8": -0.6, "total_rech_num_7": -0.3}),
    "Value card": Scorecard(-0.2, {"arpu_8": -0.002, "total_og_mou_8": -0.001}),
}
"""Three transparent scores, compared by the same reports as trained models."""
PAIRS = [("Blend card", "Recharge card"), ("Blend card", "Value card"), ("Recharge card", "Value card")]
SCREENED = list(MODEL_FEATURES)
DATA_FLAGS = [f"{m}_{p}" for m in ("total_rech_data", "max_rech_data", "fb_user") for p in (6, 7, 8)] + [
    "arpu_6",
    "arpu_7",
    "arpu_8",
]


def split_panel(panel: DataFrame) -> DataFrame:
    return splitting.join_split(panel)


def null_counts(panel: DataFrame) -> DataFrame:
    """A handful of rows per column, stored because several reports read it twice."""
    return materialise(missingness.null_counts(split_panel(panel)))


def development(panel: DataFrame) -> DataFrame:
    return split_panel(panel).filter(F.col("split") == splitting.DEVELOPMENT)


def high_missing(panel: DataFrame) -> DataFrame:
    rows = split_panel(panel)
    spread = missingness.value_spread(rows.filter(F.col("split") == splitting.DEVELOPMENT))
    return missingness.high_missing_profile(missingness.null_counts(rows), spread)


def treatments(panel: DataFrame) -> DataFrame:
    rows = split_panel(panel)
    return missingness.treatment_map(
        missingness.null_counts(rows), missingness.unique_counts(rows.filter(F.col("split") == splitting.DEVELOPMENT))
    )


def register(panel: DataFrame) -> DataFrame:
    rows = split_panel(panel)
    return missingness.feature_register(
        missingness.null_counts(rows), missingness.constant_check(rows.filter(F.col("split") == splitting.DEVELOPMENT))
    )


def date_audit(panel: DataFrame) -> DataFrame:
    ends = {c: FIXTURE_CALENDAR.orders[int(c[-1])][1] for c in features.DATE_COLUMNS}
    return missingness.date_audit(panel, ends)


def shown(df: DataFrame, block: dict[str, str], whole: tuple[str, ...] = ()) -> DataFrame:
    """(id, features of one block) with doubles rounded for display."""
    kinds = dict(df.select(*block).dtypes)
    return df.select(
        "id",
        *[rounded(c, 6).alias(c) if kinds[c] == "double" and c not in whole else F.col(c) for c in block],
    )


def block(make: Callable[[], dict[str, str]]) -> Callable[[DataFrame], DataFrame]:
    return lambda panel: shown(features.build_features(panel), make())


def imputation_audit(panel: DataFrame) -> DataFrame:
    """Development median per feature and missing values before and after filling, per split."""
    rows = modelling.feature_rows(panel)
    medians = modelling.development_medians(rows)
    filled = features.impute(rows, medians, SCREENED)

    def counts(df: DataFrame, name: str) -> DataFrame:
        wide = df.groupBy("split").agg(*[F.expr(f"count_if({c} IS NULL)").alias(c) for c in SCREENED])
        entries = ", ".join(f"struct('{c}' AS feature, {c} AS {name})" for c in SCREENED)
        return wide.selectExpr("split", f"inline(array({entries}))")

    entries = ", ".join(f"struct('{c}' AS feature, {c} AS median)" for c in SCREENED)
    fitted = medians.selectExpr(f"inline(array({entries}))")
    return (
        counts(rows, "missing_before")
        .join(F.broadcast(counts(filled, "missing_after")), ["split", "feature"])
        .join(F.broadcast(fitted), "feature")
        .select("feature", "split", rounded("median", 6).alias("median"), "missing_before", "missing_after")
    )


def invariance(panel: DataFrame) -> DataFrame:
    """Filling model features must leave the data-service columns' missing values alone."""
    structural = [f"{m}_8" for m in features.STRUCTURAL]
    rows = materialise(
        splitting.join_split(features.build_features(panel).select("id", "label", *SCREENED, *structural))
    )
    filled = features.impute(rows, modelling.development_medians(rows), SCREENED)
    before = rows.agg(*[F.expr(f"count_if({c} IS NULL)").alias(f"b_{c}") for c in structural]).withColumn("_one", F.lit(1))
    after = filled.agg(*[F.expr(f"count_if({c} IS NULL)").alias(f"a_{c}") for c in structural]).withColumn(
        "_one", F.lit(1)
    )
    entries = ", ".join(
        f"struct('{c}' AS feature, b_{c} AS missing_before, a_{c} AS missing_after, b_{c} = a_{c} AS unchanged)"
        for c in structural
    )
    return before.join(after, "_one").selectExpr(f"inline(array({entries}))")


def recency_flags(panel: DataFrame) -> DataFrame:
    names = [f"voice_rech_recency_{p}" for p in (6, 7, 8)]
    rows = materialise(features.build_features(panel).select("id", *names))
    return features.high_recency_flags(rows, names).select("id", *[f"{n}_high_flag" for n in names])


def sanity(panel: DataFrame) -> DataFrame:
    names = [n for n in features.feature_names() if n != "tenure_band"]
    return selection.numeric_sanity(features.build_features(panel), names)


def filled_development(panel: DataFrame) -> DataFrame:
    rows = modelling.feature_rows(panel)
    filled = features.impute(rows, modelling.development_medians(rows), SCREENED)
    return materialise(filled.filter(F.col("split") == splitting.DEVELOPMENT))


def correlated(panel: DataFrame) -> DataFrame:
    return selection.spearman_pairs(filled_development(panel), SCREENED)


REDUNDANT_IN_FIXTURE = 0.90


def redundancy(panel: DataFrame) -> DataFrame:
    return selection.redundancy_groups(materialise(correlated(panel)), REDUNDANT_IN_FIXTURE)


def representatives(panel: DataFrame) -> DataFrame:
    rows = modelling.feature_rows(panel)
    dev = rows.filter(F.col("split") == splitting.DEVELOPMENT)
    counts = dev.agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"count_if({c} IS NULL)").alias(c) for c in SCREENED]
    )
    entries = ", ".join(f"struct('{c}' AS feature, {c} * 100D / n AS missing_pct)" for c in SCREENED)
    missing = counts.selectExpr(f"inline(array({entries}))")
    filled = materialise(features.impute(rows, modelling.development_medians(rows), SCREENED))
    pairs = selection.spearman_pairs(filled.filter(F.col("split") == splitting.DEVELOPMENT), SCREENED)
    return selection.representatives(
        selection.redundancy_groups(materialise(pairs), REDUNDANT_IN_FIXTURE), missing
    )


def indicator_redundancy(panel: DataFrame) -> DataFrame:
    flags = [f"{c}_missing" for c in ("arpu_6", "arpu_7", "arpu_8", "fb_user_8", "max_rech_data_8", "aon")]
    rows = split_panel(panel).filter(F.col("split") == splitting.DEVELOPMENT)
    named = rows.select("id", *[F.expr(f"int({f.removesuffix('_missing')} IS NULL)").alias(f) for f in flags])
    return selection.spearman_pairs(named, flags)


def measures(panel: DataFrame) -> list[str]:
    """All columns that can be missing."""
    return [c for c in panel.columns if c not in ("id", "label")]


def indicator_redundancy_of_all(panel: DataFrame) -> DataFrame:
    """Spearman correlation of 0/1 flags is their Pearson correlation: one pass, no ranks."""
    flags = development(panel).select(*[F.expr(f"cast({c} IS NULL AS double)").alias(f"{c}_missing") for c in measures(panel)])
    pairs = selection.pearson_pairs(flags, flags.columns)
    return pairs.select("feature_1", "feature_2", rounded(F.abs("correlation"), 6).alias("abs_spearman_correlation"))


def information(panel: DataFrame) -> DataFrame:
    rows = modelling.feature_rows(panel)
    return selection.binned_information(rows.filter(F.col("split") == splitting.DEVELOPMENT), SCREENED)


def nearest(panel: DataFrame) -> DataFrame:
    matrix = modelling.model_matrix(panel).filter("fold IS NOT NULL")
    return nearest_information.nearest_information(matrix, SCREENED)


def stability(panel: DataFrame) -> DataFrame:
    matrix = modelling.model_matrix(panel).filter("fold IS NOT NULL")
    return selection.univariate_stability(matrix, SCREENED)


def matrix_families(panel: DataFrame) -> DataFrame:
    """Rows, complete rows and features per family of the exported model matrix."""
    matrix = modelling.model_matrix(panel)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in SCREENED)
    entries = [
        F.struct(F.lit(c).alias("feature"), missingness.feature_family(F.lit(c)).alias("feature_family"))
        for c in SCREENED
    ]
    sizes = matrix.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"count_if({complete})").alias("complete_rows"))
    return (
        sizes.select("rows", "complete_rows", F.inline(F.array(*entries)))
        .groupBy("feature_family", "rows", "complete_rows")
        .agg(F.count(F.lit(1)).alias("feature_count"))
    )


def export_matrix(panel: DataFrame, path: str) -> DataFrame:
    """Store the model matrix partitioned by split, keyed by id; returns what was stored."""
    from holdfast.sources.contract import write_reconciled

    return write_reconciled(modelling.model_matrix(panel), path, partition_by=["split"])


def card_scores(panel: DataFrame) -> DataFrame:
    """Long (model, split, fold, id, label, score) of the three cards, stored once."""
    rows = panel
    for i, card in enumerate(CARDS.values()):
        rows = with_score(rows, card, f"s{i}")
    rows = splitting.join_split(rows.select("id", "label", "s0", "s1", "s2"))
    dev = rows.filter(F.col("split") == splitting.DEVELOPMENT)
    folds = splitting.with_fold(dev.select("id", "label")).select("id", "fold")
    entries = ", ".join(f"struct('{name}' AS model, s{i} AS score)" for i, name in enumerate(CARDS))
    return materialise(
        rows.join(folds, "id", "left").selectExpr("id", "label", "split", "fold", f"inline(array({entries}))")
    )


def card_folds(panel: DataFrame) -> DataFrame:
    return materialise(evaluation.fold_results(card_scores(panel).filter("fold IS NOT NULL")))


def card_comparison(panel: DataFrame) -> DataFrame:
    scores = card_scores(panel)
    summary = evaluation.model_summary(evaluation.fold_results(scores.filter("fold IS NOT NULL")))
    holdout = evaluation.fold_results(scores.filter(F.col("split") == splitting.VALIDATION), ("model",))
    return evaluation.holdout_comparison(holdout, summary)


def dummy_baselines(panel: DataFrame) -> DataFrame:
    rows = splitting.with_split(panel.select("id", "label"))
    return evaluation.fold_results(modelling.dummy_scores(rows), ("model",))


def trained_logistic(panel: DataFrame) -> DataFrame:
    matrix = modelling.model_matrix(panel)
    dev = matrix.filter("fold IS NOT NULL")
    model = modelling.logistic(MODEL_FEATURES, dev.count()).fit(dev)
    return modelling.coefficients(model, MODEL_FEATURES, matrix)


def calibration_scores(panel: DataFrame) -> DataFrame:
    rows = splitting.with_fold(scored(panel).select("id", "label", "score"))
    return materialise(rows)


def fitted_sigmoid(panel: DataFrame) -> DataFrame:
    """Sigmoid-calibrated probability of every customer."""
    rows = calibration_scores(panel)
    return calibration.apply_sigmoid(rows, calibration.fit_sigmoid(rows)).select("id", rounded("score", 5).alias("score"))


def fitted_isotonic(panel: DataFrame) -> DataFrame:
    rows = calibration_scores(panel)
    return calibration.fit_isotonic(rows)(rows).select("id", rounded("score", 6).alias("score"))


def slope_table(panel: DataFrame) -> DataFrame:
    rows = calibration_scores(panel)
    slope, intercept = calibration.slope_intercept(rows)
    return rows.groupBy(F.lit("score").alias("column")).agg(
        F.count(F.lit(1)).alias("customers"),
        rounded(F.first(F.lit(slope)), 4).alias("calibration_slope"),
        rounded(F.first(F.lit(intercept)), 4).alias("calibration_intercept"),
    )


TRAINED_PAIRS = list(combinations((trained.LOGISTIC, *trained.BASELINES), 2))


def trained_folds(panel: DataFrame) -> DataFrame:
    return materialise(trained.fold_results(panel))


def raw_scores(panel: DataFrame) -> DataFrame:
    """Scores of the final model before calibration."""
    return trained.final_scores(panel).withColumnRenamed("raw", "score")


STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "f01_ingest_contract": lambda p: contract_checks(p),
    "f03_missingness_profile": lambda p: missingness.missingness_profile(null_counts(p)),
    "f04_missingness_stability": lambda p: missingness.missingness_stability(null_counts(p)),
    "f05_missingness_by_label": lambda p: missingness.missingness_by_label(null_counts(p)),
    "f06_high_missing_profile": high_missing,
    "f07_voice_zero_vs_missing": lambda p: missingness.voice_zero_or_missing(null_counts(p)),
    "f08_missingness_correlation": lambda p: selection.missing_correlation(development(p), DATA_FLAGS),
    "f08_missingness_correlation_all": lambda p: selection.missing_correlation(development(p), measures(p)),
    "f09_treatment_map": treatments,
    "f10_feature_register": register,
    "f11_date_recency": date_audit,
    "f11_recency_features": block(features.recencies),
    "f12_missing_indicators": block(features.missing_indicators),
    "f13_dev_median_impute": imputation_audit,
    "f14_invariance_checks": invariance,
    "f15_tenure": block(features.tenure),
    "f16_three_month_summary": block(lambda: features.summaries() | features.deviations()),
    "f17_change": block(features.changes),
    "f18_pct_change": block(features.percent_changes),
    "f19_monthly_totals": block(lambda: features.monthly_totals() | features.activity_changes()),
    "f20_inactivity_flags": block(features.inactivity),
    "f21_recent_vs_baseline": block(features.versus_baseline),
    "f22_value_ratios": block(features.value_ratios),
    "f23_no_recharge_flags": block(features.no_recharge),
    "f24_decline_count": block(features.decline_count),
    "f25_trend_score": block(features.trend_scores),
    "f26_value_availability": block(features.value_availability),
    "f27_recency_high_flag": recency_flags,
    "f29_numeric_sanity": sanity,
    "f30_spearman_pairs": correlated,
    "f31_redundancy_groups": redundancy,
    "f32_representative_pick": representatives,
    "f33_indicator_redundancy": indicator_redundancy,
    "f33_indicator_redundancy_all": indicator_redundancy_of_all,
    "f34_mutual_information": information,
    "f34_mutual_information_nearest": nearest,
    "f35_univariate_stability": stability,
    "f38_model_matrix_export": matrix_families,
    "m00_foundation_audit": lambda p: modelling.audit(modelling.model_matrix(p)),
    "m05_dummy_baselines": dummy_baselines,
    "m06_logistic": trained_logistic,
    "m07_tree_boosting": trained.holdout_results,
    "m09_cv_oof": card_folds,
    "m09_cv_oof_trained": trained.fold_results,
    "m10_cv_summary": lambda p: evaluation.model_summary(card_folds(p)),
    "m10_fold_ranking": lambda p: evaluation.fold_ranking(card_folds(p)),
    "m11_pairwise_models": lambda p: evaluation.pairwise_models(card_folds(p), PAIRS),
    "m12_tuning_grid": trained.tune,
    "m13_tuning_selection": lambda p: evaluation.tuning_selection(trained.tune(p)),
    "m14_holdout_compare": card_comparison,
    "m15_final_selection": lambda p: evaluation.final_model(card_comparison(p)),
    "m10_cv_summary_trained": lambda p: evaluation.model_summary(trained_folds(p)),
    "m10_fold_ranking_trained": lambda p: evaluation.fold_ranking(trained_folds(p)),
    "m11_pairwise_models_trained": lambda p: evaluation.pairwise_models(trained_folds(p), TRAINED_PAIRS),
    "m14_holdout_compare_trained": trained.comparison,
    "m15_final_selection_trained": lambda p: evaluation.final_model(trained.comparison(p)),
    "m16_final_fit_save": trained.save_and_compare,
    "m17_schema_fingerprint": lambda p: modelling.fingerprint(p.select("id", "label", "aon", "arpu_8")),
    "m17_schema_fingerprint_all": modelling.fingerprint,
    "c01_sigmoid_calibrate": fitted_sigmoid,
    "c02_isotonic_calibrate": fitted_isotonic,
    "c05_slope_intercept": slope_table,
    "c06_method_compare": lambda p: calibration.compare_methods(calibration_scores(p), splitting.FOLDS),
    "c07_rank_preservation": lambda p: calibration.rank_preservation(scored(p)),
    "c08_validation_before_after": lambda p: calibration.before_after(
        splitting.with_split(scored(p)).filter(F.col("split") == splitting.VALIDATION)
    ),
    "c07_rank_preservation_fitted": lambda p: calibration.rank_preservation(raw_scores(p), trained.final_sigmoid(p)),
    "c08_validation_before_after_fitted": lambda p: calibration.before_after(
        raw_scores(p).filter(F.col("split") == splitting.VALIDATION), trained.final_sigmoid(p)
    ),
    "x01_attribution_long": lambda p: attribution.attribution_table(attribution.prepared(p)),
    "x01_additivity": lambda p: attribution.additivity(attribution.prepared(p)),
    "x02_global_importance": lambda p: attribution.global_importance(attribution.prepared(p)),
    "x03_direction": lambda p: attribution.direction(attribution.prepared(p)),
    "x04_top_drivers": lambda p: attribution.top_drivers(attribution.prepared(p)),
    "x05_top_risk_profiles": lambda p: attribution.top_risk_profiles(attribution.prepared(p)),
} | trained.TREE_ATTRIBUTION | selection_chain.STAGES
