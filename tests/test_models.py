"""Splits, selection, training, calibration and attribution."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from holdfast.operators import attribution, calibration, modelling, selection, splitting
from holdfast.operators.metrics import rank_metrics
from holdfast.operators.missingness import feature_family
from holdfast.operators.scoring import scored
from holdfast.plans import model_stages
from holdfast.sources.panel import panel

SF = "/root/testdata/sf0.001"


def test_split_and_folds_are_stratified_and_repeatable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    one = splitting.with_split(df).select("id", "label", "split")
    two = splitting.with_split(df.repartition(3)).select("id", F.col("split").alias("again"))
    assert one.join(two, "id").filter("split <> again").isEmpty()
    sizes = {(r.label, r.split): r["count"] for r in one.groupBy("label", "split").count().collect()}
    pos = sum(1 for i in range(1003) if i % 7 == 0)
    assert sizes[1, "development"] == int(np.ceil(pos * 0.8))
    folds = splitting.with_fold(df).groupBy("label", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in folds if r.label == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_redundancy_groups_are_connected_components(spark):
    pairs = [("a", "b", 0.99), ("b", "c", 0.96), ("c", "d", 0.5), ("e", "f", 0.97), ("f", "g", 1.0), ("g", "h", 0.95)]
    df = spark.createDataFrame(pairs, "feature_1 string, feature_2 string, abs_spearman_correlation double")
    got = {r.feature: r.group_id for r in selection.redundancy_groups(df).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "e": 2, "f": 2, "g": 2, "h": 2}
    names = {"a": "arpu_8", "b": "arpu_change_7_to_8", "c": "arpu_6"}
    groups = spark.createDataFrame([(names[k], 1) for k in names], "feature string, group_id bigint")
    missing = spark.createDataFrame([(v, 5.0) for v in names.values()], "feature string, missing_pct double")
    picked = {r.feature: (r.decision, r.representative) for r in selection.representatives(groups, missing).collect()}
    assert picked["arpu_8"] == ("Retain", "arpu_8")
    assert picked["arpu_6"] == ("Exclude", "arpu_8")


def test_spearman_and_information_match_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 9, n).astype(float)})
    pdf["b"] = pdf.a**3 + rng.normal(size=n) * 20
    pdf["c"] = rng.normal(size=n)
    pdf["label"] = (pdf.a + rng.normal(size=n) > 4).astype(int)
    df = spark.createDataFrame(pdf)
    got = {(r.feature_1, r.feature_2): r.abs_spearman_correlation for r in selection.spearman_pairs(df, ["a", "b", "c"]).collect()}
    want = pdf[["a", "b", "c"]].rank().corr().abs()
    assert got == {k: pytest.approx(want.loc[k], abs=1e-6) for k in (("a", "b"), ("a", "c"), ("b", "c"))}
    info = {r.feature: r.mutual_information for r in selection.binned_information(df, ["a", "c"]).collect()}
    edges = np.quantile(pdf.a, [i / 10 for i in range(1, 10)])
    cells = pd.crosstab((pdf.a.to_numpy()[:, None] > edges).sum(1), pdf.label).to_numpy() / n
    outer = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True)
    assert info["a"] == pytest.approx((cells[cells > 0] * np.log(cells[cells > 0] / outer[cells > 0])).sum(), abs=1e-6)
    assert info["a"] > info["c"]


def test_final_selection_keeps_protected_and_falls_back(spark):
    stability = spark.createDataFrame(
        [("arpu_8", 0.5, 0.0, False), ("noise", 0.5, 0.0, False), ("useful", 0.6, 1.0, True)],
        "feature string, mean_cv_auc double, stability_rate double, stable boolean",
    )
    weight = spark.createDataFrame([("noise", -0.1), ("useful", 0.0)], "feature string, importance double")
    got = {r.feature: r.status for r in selection.final_selection(stability, weight).collect()}
    assert got == {"arpu_8": "Retained", "noise": "Excluded", "useful": "Retained"}
    only = stability.filter("feature = 'noise'")
    assert [r.status for r in selection.final_selection(only, weight).collect()] == ["Retained"]


def test_exported_matrix_is_complete_and_partitioned(spark, tmp_path):
    stored = model_stages.export_matrix(panel(spark, SF), str(tmp_path / "matrix"))
    assert stored.count() == 150
    assert list((tmp_path / "matrix").glob("v-*/split=development"))
    complete = " AND ".join(f"{c} IS NOT NULL" for c in modelling.MODEL_FEATURES)
    assert stored.filter(f"NOT ({complete})").isEmpty()
    families = spark.createDataFrame(
        [("arpu_8", "Customer Value", "Retained"), ("aon", "Customer Tenure", "Excluded")],
        "feature string, feature_family string, status string",
    )
    assert [tuple(r) for r in selection.family_summary(families).collect()] == [("Customer Value", 1)]


def test_feature_families(spark):
    names = ["aon", "arpu_8", "total_rech_amt_8", "loc_og_mou_8", "vol_2g_mb_8", "total_activity_change_6_to_8"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r[0] for r in df.select(feature_family(F.col("f"))).collect()] == [
        "Customer Tenure", "Customer Value", "Recharge Activity", "Voice / Call Behavior", "Data Engagement", "Temporal Change",
    ]


@pytest.fixture(scope="module")
def learnable(spark):
    """Rows whose label follows one column, as a model matrix."""
    rng = np.random.default_rng(11)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.normal(size=n), "noise": rng.normal(size=n)})
    pdf["label"] = (rng.random(n) < 1 / (1 + np.exp(-2 * pdf.x))).astype(int)
    rows = splitting.with_split(spark.createDataFrame(pdf))
    folds = splitting.with_fold(rows.filter("split = 'development'").select("id", "label")).select("id", "fold")
    return rows.join(folds, "id", "left").cache()


def test_models_beat_chance_and_importance_finds_the_signal(learnable):
    columns = ("x", "noise")
    fits = {
        "lr": modelling.logistic(columns, 480),
        "gbt": modelling.boosted_trees(columns, modelling.TreeParams(iterations=3, depth=2)),
    }
    scores = modelling.holdout_scores(learnable, fits)
    aucs = {r.model: r.roc_auc for r in rank_metrics(scores, ["model"]).collect()}
    assert min(aucs.values()) > 0.7
    model = fits["lr"].fit(learnable)
    drops = {r.feature: r.importance for r in modelling.permutation_importance(model, learnable, columns, 1).collect()}
    assert drops["x"] > 0.2 > abs(drops["noise"])
    signs = {r.feature: r.coefficient for r in modelling.coefficients(model, columns, learnable).collect()}
    assert signs["x"] > abs(signs["noise"])
    cv = modelling.cross_validate(learnable, {"lr": fits["lr"]})
    development = learnable.filter("fold IS NOT NULL").count()
    assert cv.held_out.select("fold").distinct().count() == 5
    assert cv.held_out.count() == cv.held_out.select("id").distinct().count() == development
    assert cv.training.count() == 4 * development


def test_calibration_is_monotone_and_improves_a_distorted_score(spark):
    rng = np.random.default_rng(2)
    p = rng.random(1500)
    pdf = pd.DataFrame({"id": np.arange(1500), "label": (rng.random(1500) < p).astype(int), "score": p**3})
    df = spark.createDataFrame(pdf).cache()
    before = rank_metrics(df).first().brier_score
    sigmoid = calibration.fit_sigmoid(df)
    assert sigmoid.slope > 0
    assert rank_metrics(calibration.apply_sigmoid(df, sigmoid)).first().brier_score < before
    iso = calibration.fit_isotonic(df)(df).select("id", F.col("score").alias("new")).join(df, "id").orderBy("score").toPandas()
    assert (iso.new.diff().dropna() >= -1e-12).all()
    assert iso.new.between(0, 1).all()
    assert calibration.rank_preservation(df).first().ranking_spearman_vs_uncalibrated == pytest.approx(1, abs=1e-4)


def test_attribution_adds_up(spark):
    rows = attribution.prepared(panel(spark, SF))
    check = attribution.additivity(rows).first()
    assert check.customers == 150 and check.violations == 0
    drivers = attribution.top_drivers(rows)
    assert drivers.count() == 150
    bad = drivers.filter("positive_driver_1_contribution <= 0 OR negative_driver_1_contribution >= 0")
    assert bad.isEmpty()
    profiles = attribution.top_risk_profiles(rows, k=7).collect()
    assert len(profiles) == 7


def test_imputation_is_fitted_on_development_rows(spark):
    rows = spark.createDataFrame(
        [(1, 0, "development", 1.0), (2, 0, "development", 3.0), (3, 1, "validation", 100.0), (4, 1, "validation", None)],
        "id bigint, label int, split string, x double",
    )
    from holdfast.operators.features import impute

    filled = impute(rows, modelling.development_medians(rows, ("x",)), ["x"])
    assert {r.id: r.x for r in filled.collect()} == {1: 1.0, 2: 3.0, 3: 100.0, 4: 2.0}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    a = modelling.fingerprint(df).first()
    assert a == modelling.fingerprint(df.repartition(5)).first()
    assert a != modelling.fingerprint(df.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v")))).first()


def test_spearman_sees_every_row(spark):
    """The rows behind the ten thousandth reverse the correlation; ties share the mean of their ranks."""
    n = 16_000
    x = np.arange(n, dtype=float)
    y = np.where(x < 10_000, x, 40_000 - 3 * x)
    z = np.where(x % 3 == 0, 0.0, x // 7)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "y": y, "z": z})
    got = {(r.feature_1, r.feature_2): r.abs_spearman_correlation for r in selection.spearman_pairs(spark.createDataFrame(pdf), ["x", "y", "z"]).collect()}
    want = pdf[["x", "y", "z"]].corr("spearman").abs()
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b], abs=2e-6)
    assert got[("x", "y")] < 0.9


def test_isotonic_tells_scores_apart_at_the_eighth_digit(spark):
    rows = [(i, int(i >= 50), 0.5 + i * 1e-8) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    fitted = {r.id: r.score for r in calibration.fit_isotonic(df)(df).collect()}
    assert max(fitted[i] for i in range(50)) < 0.01 < 0.99 < min(fitted[i] for i in range(50, 100))


def test_importance_of_many_features_in_chunks(learnable, monkeypatch):
    monkeypatch.setattr(modelling, "SWAPPED_AT_ONCE", 1)
    columns = ("x", "noise")
    model = modelling.logistic(columns, 480).fit(learnable)
    rows = modelling.permutation_importance(model, learnable, columns, 3).collect()
    assert [r.importance_rank for r in sorted(rows, key=lambda r: -r.importance)] == [1, 2]
    assert {r.feature for r in rows} == set(columns) and all(r.importance_std >= 0 for r in rows)


def test_reports_of_all_columns(spark):
    """Missingness, drift and content of every column, not of a list written down."""
    p = panel(spark, SF).cache()
    try:
        _check_reports_of_all_columns(spark, p)
    finally:
        p.unpersist()  # a cached panel would answer every later query of the session


def _check_reports_of_all_columns(spark, p):
    flags = p.drop("id", "label").columns
    stages = __spark_entry__.ALL_STAGES
    dev = splitting.join_split(p).filter("split = 'development'").toPandas()[flags].isna().astype(float)
    want = dev.corr().stack()
    got = {(r.feature_1, r.feature_2): r.correlation for r in stages["f08_missingness_correlation_all"](p).collect()}
    varied = [c for c in flags if dev[c].nunique() > 1]
    assert len(got) == len(varied) * (len(varied) - 1) // 2 > 66
    assert all(v == pytest.approx(want.loc[k], abs=2e-6) for k, v in got.items())
    pairs = {(r.feature_1, r.feature_2): r.abs_spearman_correlation for r in stages["f33_indicator_redundancy_all"](p).collect()}
    assert {(f"{a}_missing", f"{b}_missing") for a, b in got} <= set(pairs)
    assert all(pairs[f"{a}_missing", f"{b}_missing"] == pytest.approx(abs(v), abs=2e-6) for (a, b), v in got.items())
    one = stages["m17_schema_fingerprint_all"](p).first()
    for c in ("arpu_6", "fb_user_7", "date_of_last_rech_8"):
        changed = p.withColumn(c, F.when(F.col("id") == 5, None).otherwise(F.col(c)))
        again = p.filter(f"id = 5 AND {c} IS NULL").isEmpty()
        assert (modelling.fingerprint(changed).first() != one) == again
    drift = {r.feature: r for r in stages["d01_drift_monitor_all"](p).collect()}
    numeric = [n for n, t in p.dtypes if t != "string" and not t.startswith(("date", "timestamp")) and n not in ("id", "label")]
    assert set(numeric) < set(drift) and {"arpu_avg_6_8", "fb_user_8_missing"} <= set(drift) and len(drift) > 200
    known = {r.feature: r for r in stages["d01_drift_monitor"](p).collect()}
    assert {f: drift[f] for f in known} == known
    gone = {c for c in numeric if dev[c].all()}
    assert all(drift[c].psi is None and drift[c].reference_missing_pct == 100 for c in gone)
