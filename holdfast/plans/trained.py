"""Trained models behind the reports: fitted once for a content of the panel, stored, and read by every later query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import rounded
from holdfast.operators import attribution, boosting, calibration, evaluation, modelling, saved_model, tree_attribution
from holdfast.operators.boosting import BoostParams, Fit
from holdfast.operators.features import build_features
from holdfast.operators.modelling import MODEL_FEATURES
from holdfast.operators.quantiles import medians
from holdfast.operators.scoring import Sigmoid
from holdfast.operators.splitting import DEVELOPMENT, FOLDS, VALIDATION
from holdfast.session import materialise
from holdfast.sources.published import content_key, published_version, stages_folder, stored_copy, stored_stage


def _leafwise(trees: int, rate: float, leaves: int, rows: int, l2: float) -> BoostParams:
    return BoostParams(trees, rate, leaves=leaves, min_rows=rows, min_hessian=1e-3, l2=l2)


def _levelwise(
    trees: int, rate: float, depth: int, hessian: float, share: float = 1.0, gamma: float = 0.0, l1: float = 0.0, l2: float = 1.0
) -> BoostParams:
    return BoostParams(trees, rate, depth, min_hessian=hessian, rows=share, columns=share, min_gain=gamma, l1=l1, l2=l2)


# Candidate settings of the two tree families.
TUNING_GRID: dict[str, dict[str, BoostParams]] = {
    "HistGradientBoosting": {
        "HGB_00_BASELINE": _leafwise(100, 0.10, 31, 20, 0.0),
        "HGB_01_SLOWER_MORE_TREES": _leafwise(200, 0.05, 31, 20, 0.0),
        "HGB_02_MODERATE_MORE_TREES": _leafwise(150, 0.08, 31, 20, 0.0),
        "HGB_03_MORE_TREES": _leafwise(150, 0.10, 31, 20, 0.0),
        "HGB_04_MORE_COMPLEX": _leafwise(150, 0.08, 63, 20, 0.0),
        "HGB_05_REGULARIZED": _leafwise(150, 0.08, 31, 20, 1.0),
        "HGB_06_LARGER_LEAF": _leafwise(150, 0.08, 31, 40, 0.0),
        "HGB_07_SHALLOWER": _leafwise(150, 0.08, 15, 20, 0.0),
        "HGB_08_SLOWER_COMPLEX": _leafwise(200, 0.05, 63, 20, 1.0),
        "HGB_09_STRONG_REGULARIZATION": _leafwise(150, 0.08, 31, 30, 5.0),
    },
    "XGBoost": {
        "XGB_00_BASELINE": _levelwise(100, 0.10, 6, 1),
        "XGB_01_MORE_TREES": _levelwise(150, 0.08, 6, 1),
        "XGB_02_SLOWER_MORE_TREES": _levelwise(200, 0.05, 6, 1, 0.9),
        "XGB_03_SHALLOWER": _levelwise(150, 0.08, 4, 1),
        "XGB_04_DEEPER": _levelwise(150, 0.08, 8, 1, 0.9),
        "XGB_05_MIN_CHILD": _levelwise(150, 0.08, 6, 3, 0.9),
        "XGB_06_SUBSAMPLED": _levelwise(150, 0.08, 6, 1, 0.8),
        "XGB_07_REGULARIZED": _levelwise(150, 0.08, 6, 3, 0.9, 0.1, 0.1, 2.0),
        "XGB_08_STRONG_REGULARIZATION": _levelwise(200, 0.05, 5, 3, 0.9, 0.1, 0.1, 2.0),
        "XGB_09_BALANCED": _levelwise(200, 0.05, 6, 5, 0.9, l2=2.0),
    },
}
BASELINES = {"HistGradientBoosting": "HGB_00_BASELINE", "XGBoost": "XGB_00_BASELINE"}
FINAL = "XGB_02_SLOWER_MORE_TREES"
LOGISTIC = "Logistic Regression"
EVERY_FOLD = tuple(range(FOLDS + 1))
"""0: all development rows."""

_SCORES = ("model", "without", "id", "label", "fold", "score")


def _logistic_scores(matrix: DataFrame, without: tuple[int, ...]) -> DataFrame:
    """The logistic regression without each given fold in turn, as scores of all rows."""
    rows = {k: matrix.filter(F.col("fold").isNotNull() & (F.col("fold") != k)) for k in without}
    n = matrix.filter("fold IS NOT NULL").count()
    sizes = {k: n if k == 0 else n * (FOLDS - 1) // FOLDS for k in without}
    models = modelling.fit_all([(modelling.logistic(MODEL_FEATURES, sizes[k]), rows[k]) for k in without])
    fold = matrix.select("id", F.coalesce("fold", F.lit(0)).alias("fold"))
    parts = [modelling.predict(m, matrix, LOGISTIC).withColumn("without", F.lit(k)) for k, m in zip(without, models)]
    return modelling.union_all(parts).join(fold, "id").select(*_SCORES)


def baseline_settings() -> dict[str, BoostParams]:
    return {family: TUNING_GRID[family][name] for family, name in BASELINES.items()}


def baseline_scores(panel: DataFrame, without: tuple[int, ...]) -> DataFrame:
    """(model, without, id, label, fold, score): three models, each without one fold in turn (0: without none)."""
    settings = baseline_settings()

    def build(p: DataFrame) -> DataFrame:
        matrix = modelling.model_matrix(p)
        fits = [Fit(family, params, k) for family, params in settings.items() for k in without]
        trees = boosting.fit_models(matrix, list(MODEL_FEATURES), fits).scores()
        return trees.select(*_SCORES).union(_logistic_scores(matrix, without))

    return stored_stage(panel, "baselines", (settings, MODEL_FEATURES, without), build)


def out_of_fold(scores: DataFrame) -> DataFrame:
    """(model, fold, id, label, score) of development rows by models that did not see them."""
    return scores.filter("fold > 0 AND without = fold").select("model", "fold", "id", "label", "score")


def of_training_rows(scores: DataFrame) -> DataFrame:
    """Scores of the rows each cross-validation fit has seen; fold is the one it has not."""
    seen = scores.filter("fold > 0 AND without > 0 AND without <> fold")
    return seen.select("model", F.col("without").alias("fold"), "id", "label", "score")


def held_out(scores: DataFrame) -> DataFrame:
    """(model, id, label, score) of validation rows by models of all development rows."""
    return scores.filter("fold = 0 AND without = 0").select("model", "id", "label", "score")


def fold_results(panel: DataFrame) -> DataFrame:
    return evaluation.fold_results(out_of_fold(baseline_scores(panel, EVERY_FOLD[1:])))


def holdout_results(panel: DataFrame) -> DataFrame:
    return evaluation.fold_results(held_out(baseline_scores(panel, EVERY_FOLD[:1])), ("model",))


def comparison(panel: DataFrame) -> DataFrame:
    """Validation results of the trained models next to their out-of-fold ones."""
    folds = materialise(fold_results(panel))
    return evaluation.holdout_comparison(materialise(holdout_results(panel)), evaluation.model_summary(folds))


def tune(panel: DataFrame, grid: dict[str, dict[str, BoostParams]] = TUNING_GRID, baselines: dict[str, str] = BASELINES) -> DataFrame:
    """Every candidate of every family on every fold, ranked inside its family."""
    families = {name: family for family, members in grid.items() for name in members}

    def build(p: DataFrame) -> DataFrame:
        fits = [Fit(name, params, k) for members in grid.values() for name, params in members.items() for k in EVERY_FOLD[1:]]
        scores = boosting.fit_models(modelling.model_matrix(p), list(MODEL_FEATURES), fits).scores()
        parts = {"held out": out_of_fold(scores), "training": of_training_rows(scores)}
        return modelling.union_all([evaluation.fold_results(rows).withColumn("part", F.lit(name)) for name, rows in parts.items()])

    results = stored_stage(panel, "tuning", (grid, MODEL_FEATURES), build)
    held, seen = (results.filter(F.col("part") == part).drop("part") for part in ("held out", "training"))
    return evaluation.tuning_table(held, seen, families, baselines)


def final_params() -> BoostParams:
    return TUNING_GRID["XGBoost"][FINAL]


def _final_table(panel: DataFrame) -> DataFrame:
    """Nodes and margins of the final candidate, without each fold and of all development rows."""
    params = final_params()

    def build(p: DataFrame) -> DataFrame:
        return boosting.fit_models(modelling.model_matrix(p), list(MODEL_FEATURES), [Fit(FINAL, params, k) for k in EVERY_FOLD]).table

    return stored_stage(panel, "final", (params, MODEL_FEATURES), build)


def final_scores(panel: DataFrame) -> DataFrame:
    """(id, label, split, fold, raw) of every customer by a model that has not seen them."""
    rows = _final_table(panel).filter("tree IS NULL AND fit = fold")
    return rows.select(
        "id",
        "label",
        F.when(F.col("fold") > 0, DEVELOPMENT).otherwise(VALIDATION).alias("split"),
        "fold",
        (1.0 / (1.0 + F.exp(-F.col("margin")))).alias("raw"),
    )


def final_sigmoid(panel: DataFrame) -> Sigmoid:
    """The sigmoid of the final model, fitted on out-of-fold scores."""
    dev = final_scores(panel).filter(F.col("split") == DEVELOPMENT)
    return calibration.fit_sigmoid(materialise(dev.select("id", "label", F.col("raw").alias("score"))))


def trained_scores(panel: DataFrame) -> DataFrame:
    """(id, label, score, arpu_8, value): calibrated probabilities, out-of-fold for development customers."""

    def build(p: DataFrame) -> DataFrame:
        score = rounded(final_sigmoid(p).apply(F.col("raw")), 6).alias("score")
        scores = final_scores(p).select("id", score)
        value = F.greatest("arpu_8", F.lit(0.0)).alias("value")
        return p.select("id", "label", "arpu_8").join(scores, "id").select("id", "label", "score", "arpu_8", value)

    return stored_stage(panel, "scores", (final_params(), MODEL_FEATURES), build)


def on_trained(report: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A report of scores, run on the trained ones."""
    return lambda panel: report(trained_scores(panel))


def feature_table(panel: DataFrame) -> DataFrame:
    """(id, features) as a scoring job would get them: without labels, values still missing."""
    return build_features(stored_copy(panel)).select("id", *MODEL_FEATURES)


def saved(panel: DataFrame) -> saved_model.SavedModel:
    """The final model from its file; fitted, calibrated and saved where there is none for this content."""
    spark = panel.sparkSession
    path = f"{stages_folder(spark)}/model-{content_key(panel, 'model', (final_params(), MODEL_FEATURES))}"
    if published_version(spark, f"{path}/description") is None:
        rows = modelling.feature_rows(stored_copy(panel))
        fill = modelling.development_medians(rows).first().asDict()
        types = {c: t for c, t in feature_table(panel).dtypes if c != "id"}
        nodes = _final_table(panel).filter("tree IS NOT NULL AND fit = 0").withColumn("threshold", F.nanvl("threshold", F.lit(None).cast("double")))
        saved_model.save(nodes, types, {c: float(fill[c] or 0.0) for c in MODEL_FEATURES}, final_sigmoid(panel), path)
    return saved_model.load(spark, path)


def save_and_compare(panel: DataFrame) -> DataFrame:
    """Scores of the saved and loaded model against those of the fit."""
    fitted = _final_table(panel).filter("tree IS NULL AND fit = 0").select("id", (1.0 / (1.0 + F.exp(-F.col("margin")))).alias("a"))
    loaded = saved_model.raw_probability(feature_table(panel), saved(panel))
    return fitted.join(loaded, "id").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.abs(F.col("a") - F.col("raw_probability")) > 1e-12).alias("differing_scores"),
    )


def batch_scores(panel: DataFrame) -> DataFrame:
    """All customers, as a table without labels, scored by the saved model."""
    return saved_model.batch_score(feature_table(panel), saved(panel))


def attributions(panel: DataFrame) -> DataFrame:
    """(id, score, feature, value, contribution, base) of every customer and feature, stored once."""

    def build(p: DataFrame) -> DataFrame:
        return tree_attribution.contributions(feature_table(p), saved(p))

    return stored_stage(panel, "attributions", (final_params(), MODEL_FEATURES), build)


def attribution_rows(panel: DataFrame) -> DataFrame:
    return attributions(panel).select("id", "feature", "value", rounded("contribution", 6).alias("contribution"))


def attribution_direction(panel: DataFrame) -> DataFrame:
    rows = saved_model.prepared(feature_table(panel), saved(panel))
    return attribution.direction_of(attributions(panel), medians(rows, list(MODEL_FEATURES)))


def risk_profiles(panel: DataFrame, k: int = attribution.TOP_CUSTOMERS) -> DataFrame:
    """The k customers with the highest scores and what drives them."""
    long = attributions(panel)
    top = materialise(long.select("id", "score").distinct().orderBy(F.desc("score"), "id").limit(k))
    return attribution.risk_profiles_of(long.join(F.broadcast(top.select("id")), "id"))


TREE_ATTRIBUTION: dict[str, Callable[[DataFrame], DataFrame]] = {
    "x01_attribution_long_trained": attribution_rows,
    "x01_additivity_trained": lambda p: tree_attribution.additivity(attributions(p)),
    "x02_global_importance_trained": lambda p: attribution.importance_of(attributions(p)),
    "x03_direction_trained": attribution_direction,
    "x04_top_drivers_trained": lambda p: attribution.drivers_of(attributions(p)),
    "x05_top_risk_profiles_trained": risk_profiles,
}
"""Reports of the trained trees' Shapley values."""
