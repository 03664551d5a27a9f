"""Stored scores, the saved model and its Shapley values."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import connect, rows_of
from holdfast.operators import boosting, saved_model, tree_attribution
from holdfast.operators.boosting import BoostParams
from holdfast.operators.scoring import MissingFeatures
from holdfast.plans import customer_stages, trained
from holdfast.session import materialise
from holdfast.sources.panel import panel
from oracle.stages_sql import SCORED
from oracle.stages_sql import STAGES as STAGE_SQL

SF = "/root/testdata/sf0.001"
SMALL = {"HistGradientBoosting": {"H0": BoostParams(6, 0.3, leaves=5, min_rows=5, l2=0.0), "H1": BoostParams(6, 0.3, leaves=5, min_rows=5, l2=5.0)}, "XGBoost": {"X0": BoostParams(6, 0.3, 3), "X1": BoostParams(6, 0.3, 3, l2=3.0)}}


@pytest.fixture(scope="module")
def quick():
    """Small settings in the place of the published ones."""
    patch = pytest.MonkeyPatch()
    patch.setattr(trained, "final_params", lambda: BoostParams(15, 0.2, 3, rows=0.9, columns=0.9))
    patch.setattr(trained, "baseline_settings", lambda: {f: next(iter(m.values())) for f, m in SMALL.items()})
    yield
    patch.undo()


def test_published_settings():
    grid = {n: p for members in trained.TUNING_GRID.values() for n, p in members.items()}
    assert len(grid) == 20 and len(set(grid.values())) == 20
    assert grid["HGB_08_SLOWER_COMPLEX"] == BoostParams(200, 0.05, leaves=63, min_rows=20, min_hessian=1e-3, l2=1.0)
    assert grid["XGB_07_REGULARIZED"] == BoostParams(150, 0.08, 6, min_hessian=3, rows=0.9, columns=0.9, min_gain=0.1, l1=0.1, l2=2.0)
    assert trained.baseline_settings() == {"HistGradientBoosting": grid["HGB_00_BASELINE"], "XGBoost": grid["XGB_00_BASELINE"]}
    assert trained.final_params() == grid["XGB_02_SLOWER_MORE_TREES"]


def test_search_ranks_candidates_and_l2_matters(spark):
    rows = {r.candidate_id: r for r in trained.tune(panel(spark, SF), SMALL, {"HistGradientBoosting": "H0", "XGBoost": "X0"}).collect()}
    assert set(rows) == {"H0", "H1", "X0", "X1"}
    assert rows["H0"].mean_train_pr_auc != rows["H1"].mean_train_pr_auc and rows["X0"].mean_train_pr_auc != rows["X1"].mean_train_pr_auc
    assert rows["H0"].pr_auc_improvement == 0 and sorted(r.model_rank for r in rows.values()) == [1, 1, 2, 2]


def test_models_are_fitted_once_for_a_content(spark, quick, monkeypatch):
    fits, real = [], boosting.fit_models

    def counted(matrix, columns, wanted, *rest):
        fits.append(len(wanted))
        return real(matrix, columns, wanted, *rest)

    monkeypatch.setattr(boosting, "fit_models", counted)
    p = panel(spark, SF)
    stages = entry.ALL_STAGES
    for name in ("m09_cv_oof_trained", "m10_cv_summary_trained", "m11_pairwise_models_trained", "m07_tree_boosting", "m15_final_selection_trained"):
        assert stages[name](p).count() > 0
    assert fits == [10, 2]
    for name in ("t01_threshold_sweep_trained", "r05_top_risk_trained", "e05_cohort_economics_trained", "m16_final_fit_save", "r06_batch_score_trained"):
        assert stages[name](p).count() > 0
    assert fits == [10, 2, 6]
    changed = p.withColumn("aon", F.when(F.col("id") == 3, F.col("aon") + 1).otherwise(F.col("aon")))
    trained.trained_scores(changed).count()
    assert fits == [10, 2, 6, 6]


def test_no_customer_is_scored_by_a_model_that_saw_it(spark, quick):
    p = panel(spark, SF)
    rows = trained.final_scores(p).collect()
    assert len(rows) == p.count() == len({r.id for r in rows})
    assert {(r.split, r.fold > 0) for r in rows} == {("development", True), ("validation", False)}
    scores = trained.baseline_scores(p, trained.EVERY_FOLD[1:])
    assert trained.out_of_fold(scores).groupBy("model").agg(F.count_distinct("id").alias("n")).select("n").distinct().count() == 1
    both = trained.of_training_rows(scores).join(trained.out_of_fold(scores), ["model", "fold", "id"], "left_semi")
    assert both.isEmpty()


@pytest.fixture(scope="module")
def stored(spark):
    """The panel read once: its content is hashed for every query."""
    return materialise(panel(spark, SF))


@pytest.fixture(scope="module")
def scores_in_duck(stored, quick, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scores") / "scores")
    trained.trained_scores(stored).write.parquet(path)
    con = connect(SF)
    con.execute(f"CREATE VIEW trained_scores AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1.1e-6 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", [n for n in customer_stages.ON_SCORES if SCORED in STAGE_SQL.get(n, "")])
def test_reports_of_stored_scores_equal_sql(stored, quick, scores_in_duck, name):
    """The SQL of each report, with the stored scores in the place of the card's."""
    df = entry.ALL_STAGES[f"{name}_trained"](stored)
    rel = scores_in_duck.execute(STAGE_SQL[name].replace(SCORED, "sc AS (SELECT * FROM trained_scores)"))
    names = [d[0] for d in rel.description]
    want, got = rows_of(names, rel.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(names) == sorted(df.columns) and len(want) == len(got)
    assert all(close(a, b) for x, y in zip(want, got) for a, b in zip(x, y))


def test_most_reports_are_checked_on_stored_scores():
    assert sum(SCORED in STAGE_SQL.get(n, "") for n in customer_stages.ON_SCORES) >= 40


def test_saved_model_is_checked_against_the_table(spark, quick):
    p = panel(spark, SF)
    assert trained.save_and_compare(p).first() == (p.count(), 0)
    model, rows = trained.saved(p), trained.feature_table(p)
    assert "label" not in rows.columns
    with pytest.raises(MissingFeatures, match="aon"):
        saved_model.batch_score(rows.drop("aon"), model)
    with pytest.raises(saved_model.WrongType, match="aon: string"):
        saved_model.batch_score(rows.withColumn("aon", F.col("aon").cast("string")), model)
    scored = saved_model.batch_score(rows.select("id", *reversed(rows.columns[1:]), F.lit("x").alias("extra")), model)
    assert sorted(scored.collect()) == sorted(saved_model.batch_score(rows, model).collect())
    none = rows.select("id", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:]])
    assert saved_model.batch_score(none, model).select("raw_probability").distinct().count() == 1
    with pytest.raises(Exception, match="infinite value of arpu_8"):
        saved_model.batch_score(rows.withColumn("arpu_8", F.lit(float("inf"))), model).collect()


def forest(seed, trees=3, params=BoostParams(3, 0.4, 3), width=5):
    """Trees with thresholds, of random rows."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (300, width)).astype(np.uint8)
    label = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 2, 300) > 8).astype(np.int8)
    start, grown, margin = boosting.boost(x, label, np.arange(300), np.ones(300, bool), params, 6)
    return start, [t | {"threshold": t["cut"].astype(float)} for t in grown], x.astype(float), margin


def expected(tree, x, known, i=0):
    """Value of a tree when only some features are known."""
    f = tree["feature"][i]
    if f < 0:
        return tree["value"][i]
    left = tree["left"][i]
    if f in known:
        return expected(tree, x, known, left + int(x[f] > tree["threshold"][i]))
    share = tree["cover"][left] / tree["cover"][i]
    return share * expected(tree, x, known, left) + (1 - share) * expected(tree, x, known, left + 1)


@pytest.mark.parametrize("params,widest", [(BoostParams(3, 0.4, 3), 8), (BoostParams(3, 0.4, 3), 2), (BoostParams(2, 0.4, leaves=12, l2=0.5), 8)])
def test_shapley_values_equal_enumeration(params, widest, monkeypatch):
    monkeypatch.setattr(tree_attribution, "WIDEST_TABLE", widest)
    start, trees, x, margin = forest(1, params=params)
    explain = tree_attribution.Explainer(start, trees, 5)
    rows = x[:12]
    got = explain(rows)
    assert np.allclose(explain.base + explain(x).sum(axis=1), margin, atol=1e-9)
    for r, row in enumerate(rows):
        value = lambda known: sum(expected(t, row, known) for t in trees)
        assert explain.base == pytest.approx(start + value(frozenset()))
        for j in range(5):
            others = [k for k in range(5) if k != j]
            want = sum(
                factorial(n) * factorial(4 - n) / factorial(5) * (value(frozenset(s) | {j}) - value(frozenset(s))) for n in range(5) for s in combinations(others, n)
            )
            assert got[r, j] == pytest.approx(want, abs=1e-9)


def test_attribution_reports(stored, quick):
    p = stored
    stages = entry.ALL_STAGES
    n = p.count()
    assert stages["x01_additivity_trained"](p).first() == (n, 0)
    long = stages["x01_attribution_long_trained"](p).toPandas()
    assert len(long) == n * 24
    sizes = long.assign(a=long.contribution.abs()).groupby("feature").a.mean()
    for r in stages["x02_global_importance_trained"](p).collect():
        assert r.mean_abs_contribution == pytest.approx(sizes[r.feature], abs=2e-6)
    one = stages["x04_top_drivers_trained"](p).filter("id = 7").first()
    mine = long[long.id == 7].sort_values("contribution", ascending=False)
    assert one.positive_driver_1 == mine.feature.iloc[0] and one.positive_driver_1_contribution == pytest.approx(mine.contribution.iloc[0])
    assert one.negative_driver_1 == mine.feature.iloc[-1]
    assert stages["x05_top_risk_profiles_trained"](p).count() == 50
    assert stages["x03_direction_trained"](p).count() == 24
