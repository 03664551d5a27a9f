"""Screening of every numeric feature: redundancy, information, stability and importance, one after another, each stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators import boosting, evaluation, features, importance, missingness, modelling, nearest_information, selection, splitting
from holdfast.operators.boosting import BoostParams, Fit
from holdfast.plans import trained
from holdfast.session import materialise
from holdfast.sources.published import stored_stage

NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
REDUNDANT = 0.90
MI_TOP = 100
"""Features that stay candidates whatever their information."""
STABLE_FALLBACK = 50
SELECTION_TREES = BoostParams(150, 0.08, leaves=15, min_rows=20, min_hessian=1e-3, l2=1.0)
"""The published model of the importance step."""
BLOCK = 64
"""Features handled in one long table."""


def candidates(panel: DataFrame) -> list[str]:
    """All numeric columns of the panel and all numeric features built from it, in order of their names."""
    return sorted(n for n, t in features.build_features(panel).dtypes if t.startswith(NUMERIC) and n not in ("id", "label"))


def matrix(panel: DataFrame) -> DataFrame:
    """Complete rows of all candidates with split and fold."""
    names = tuple(candidates(panel))
    return stored_stage(panel, "matrix-all", names, lambda p: modelling.model_matrix(p, names))


def _development(panel: DataFrame) -> DataFrame:
    return matrix(panel).filter("fold IS NOT NULL")


def missing_shares(panel: DataFrame) -> DataFrame:
    """(feature, missing_pct) over development rows."""
    names = candidates(panel)

    def build(p: DataFrame) -> DataFrame:
        rows = splitting.join_split(features.build_features(p).select("id", "label", *names))
        dev = rows.filter(F.col("split") == splitting.DEVELOPMENT)
        counts = dev.agg(F.count(F.lit(1)).alias("_n"), *[F.expr(f"count_if({c} IS NULL)").alias(c) for c in names])
        entries = ", ".join(f"struct('{c}' AS feature, {c} * 100D / _n AS missing_pct)" for c in names)
        return counts.selectExpr(f"inline(array({entries}))")

    return stored_stage(panel, "missing-all", tuple(names), build)


def pairs(panel: DataFrame) -> DataFrame:
    """Absolute Spearman correlation of all pairs of candidates."""
    names = candidates(panel)
    return stored_stage(panel, "spearman-all", tuple(names), lambda p: selection.spearman_pairs(_development(p), names, stored=True))


def groups(panel: DataFrame) -> DataFrame:
    return selection.redundancy_groups(pairs(panel), REDUNDANT)


def representatives(panel: DataFrame) -> DataFrame:
    return selection.representatives(groups(panel), missing_shares(panel))


def _names(rows: DataFrame) -> list[str]:
    """Feature names, in order; as many rows as there are features."""
    return sorted(r["feature"] for r in rows.select("feature").collect())


def not_redundant(panel: DataFrame) -> list[str]:
    gone = set(_names(representatives(panel).filter("decision = 'Exclude'")))
    return [c for c in candidates(panel) if c not in gone]


def _in_blocks(names: list[str], one: Callable[[list[str]], DataFrame]) -> DataFrame:
    return modelling.union_all([materialise(one(names[i : i + BLOCK])) for i in range(0, len(names), BLOCK)])


def information(panel: DataFrame) -> DataFrame:
    """Nearest-neighbour information of every feature that is not redundant."""

    def build(p: DataFrame) -> DataFrame:
        rows = _development(p)
        return _in_blocks(not_redundant(p), lambda block: nearest_information.nearest_information(rows, block).drop("mi_rank"))

    scores = stored_stage(panel, "information-all", (tuple(candidates(panel)), REDUNDANT), build)
    place = F.row_number().over(nearest_information.Window.orderBy(F.desc("mutual_information"), F.asc("feature")))
    return scores.withColumn("mi_rank", place.cast("bigint"))


def informative(panel: DataFrame) -> list[str]:
    return _names(information(panel).filter((F.col("mutual_information") > 0) | (F.col("mi_rank") <= MI_TOP)))


def stability(panel: DataFrame) -> DataFrame:
    def build(p: DataFrame) -> DataFrame:
        rows = _development(p)
        return _in_blocks(informative(p), lambda block: selection.univariate_stability(rows, block))

    return stored_stage(panel, "stability-all", (tuple(candidates(panel)), REDUNDANT, MI_TOP), build)


def steady(panel: DataFrame) -> list[str]:
    rows = stability(panel)
    return _names(rows.filter("stable")) or _names(rows.orderBy(F.desc("mean_cv_auc"), "feature").limit(STABLE_FALLBACK))


def importances(panel: DataFrame) -> DataFrame:
    def build(p: DataFrame) -> DataFrame:
        names, rows = steady(p), _development(p)
        return importance.tree_importance(rows, boosting.fit_models(rows, names, [Fit("selection", SELECTION_TREES)]))

    return stored_stage(panel, "importance-all", (tuple(candidates(panel)), SELECTION_TREES, REDUNDANT, MI_TOP), build)


def selected(panel: DataFrame) -> DataFrame:
    return selection.final_selection(stability(panel), importances(panel))


def kept(panel: DataFrame) -> list[str]:
    return _names(selected(panel).filter("status = 'Retained'"))


def exported(panel: DataFrame) -> DataFrame:
    """Rows, complete rows and features per family of the matrix of what the selection keeps."""
    names = kept(panel)
    rows = matrix(panel).select("id", "split", "fold", *names)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in names)
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"count_if({complete})").alias("complete_rows"))
    entries = [F.struct(F.lit(c).alias("feature"), missingness.feature_family(F.lit(c)).alias("feature_family")) for c in names]
    return sizes.select("rows", "complete_rows", F.inline(F.array(*entries))).groupBy("feature_family", "rows", "complete_rows").agg(F.count(F.lit(1)).alias("feature_count"))


def holdout_of_selected(panel: DataFrame) -> DataFrame:
    """Validation results of the tree baselines on the features that the selection keeps."""
    settings = trained.baseline_settings()

    def build(p: DataFrame) -> DataFrame:
        fits = [Fit(family, params) for family, params in settings.items()]
        return boosting.fit_models(matrix(p), kept(p), fits).scores()

    scores = stored_stage(panel, "baselines-selected", (settings, tuple(candidates(panel)), SELECTION_TREES), build)
    return evaluation.fold_results(trained.held_out(scores), ("model",))


STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "f30_spearman_pairs_all": pairs,
    "f31_redundancy_groups_all": groups,
    "f32_representative_pick_all": representatives,
    "f34_mutual_information_all": information,
    "f35_univariate_stability_all": stability,
    "f36_permutation_importance": importances,
    "f37_final_selection": selected,
    "f38_model_matrix_export_all": exported,
    "m07_tree_boosting_selected": holdout_of_selected,
}
