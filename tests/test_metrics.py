"""Metrics against brute force over tied scores, and the threshold sweep at its edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators import evaluation, metrics, thresholds


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    n = 2000
    score = np.round(rng.beta(1.2, 2.5, n), 2)
    label = (rng.random(n) < 0.1 + 0.7 * score).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "label": label, "score": score})
    return spark.createDataFrame(pdf).cache(), pdf


def brute_auc(pdf):
    pos, neg = pdf[pdf.label == 1].score.to_numpy(), pdf[pdf.label == 0].score.to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def brute_ap(pdf):
    total, out, seen = pdf.label.sum(), 0.0, 0.0
    for s in sorted(pdf.score.unique(), reverse=True):
        chosen = pdf[pdf.score >= s]
        recall = chosen.label.sum() / total
        out += (recall - seen) * chosen.label.mean()
        seen = recall
    return out


def test_rank_metrics(scores):
    df, pdf = scores
    got = metrics.rank_metrics(df).first()
    assert got.roc_auc == pytest.approx(brute_auc(pdf), abs=1e-6)
    assert got.pr_auc == pytest.approx(brute_ap(pdf), abs=1e-6)
    p = pdf.score.clip(1e-15, 1 - 1e-15)
    loss = -(pdf.label * np.log(p) + (1 - pdf.label) * np.log(1 - p)).mean()
    assert got.log_loss == pytest.approx(loss, abs=1e-6)
    assert got.brier_score == pytest.approx(((pdf.score - pdf.label) ** 2).mean(), abs=1e-6)


def test_sweep_counts_every_threshold(scores):
    df, pdf = scores
    rows = {round(r.threshold, 2): r for r in thresholds.threshold_sweep(df).collect()}
    assert len(rows) == 81
    for t in (0.05, 0.07, 0.29, 0.57, 0.58, 0.85):
        hit = pdf.score >= t
        assert rows[t].true_positives == int((hit & (pdf.label == 1)).sum())
        assert rows[t].false_positives == int((hit & (pdf.label == 0)).sum())


def test_sweep_is_exact_at_every_edge(spark):
    """A score equal to a threshold meets it; the next smaller double does not."""
    edges = [k / 100.0 for k in range(5, 86)]
    rows = [(float(e), 1) for e in edges] + [(float(np.nextafter(e, 0)), 0) for e in edges]
    got = thresholds.threshold_sweep(spark.createDataFrame(rows, "score double, label int")).collect()
    for r in got:
        assert r.true_positives == sum(e >= r.threshold for e in edges)
        assert r.false_positives == sum(float(np.nextafter(e, 0)) >= r.threshold for e in edges)


def test_capacity_uses_floor_and_top_share_ceil(scores):
    df, pdf = scores
    part = df.filter("id < 1995")
    pp = pdf[pdf.id < 1995].sort_values(["score", "id"], ascending=[False, True])
    cap = {r.capacity_rate: r for r in thresholds.capacity_table(part).collect()}
    assert cap[0.1].targeted_customers == 199
    assert cap[0.1].churners_captured == int(pp.head(199).label.sum())
    top = {r.top_share: r for r in metrics.top_share_metrics(part).collect()}
    assert top[0.1].selected == 200
    assert top[0.1].captured == int(pp.head(200).label.sum())


def test_primary_threshold_rule(scores):
    df, _ = scores
    sweep = thresholds.threshold_sweep(df)
    best = thresholds.primary_threshold(sweep).first()
    rows = [r for r in sweep.collect() if 0.05 <= r.targeting_rate <= 0.2 and r.precision >= 0.5]
    want = sorted(rows, key=lambda r: (-r.churn_capture, -r.precision, r.targeting_rate))[0]
    assert best.threshold == want.threshold


def test_calibration_error_and_bins(scores):
    df, pdf = scores
    b = np.minimum((pdf.score * 10).astype(int), 9)
    want = sum(len(x) / len(pdf) * abs(x.score.mean() - x.label.mean()) for _, x in pdf.groupby(b))
    assert metrics.calibration_error(df).first().ece == pytest.approx(want, abs=2e-3)
    curve = metrics.reliability(df.filter("score < 0.35 OR score >= 0.8")).collect()
    assert len(curve) == 10
    assert [r.sample_count for r in sorted(curve, key=lambda r: r.bin)][4:8] == [0, 0, 0, 0]


def test_models_compared_per_fold(spark, scores):
    df, pdf = scores
    long = df.select(
        "id",
        "label",
        (F.col("id") % 2).cast("int").alias("fold"),
        F.inline(
            F.array(
                F.struct(F.lit("good").alias("model"), F.col("score").alias("score")),
                F.struct(F.lit("bad").alias("model"), (1 - F.col("score")).alias("score")),
            )
        ),
    )
    folds = evaluation.fold_results(long)
    rows = {(r.model, r.fold): r for r in folds.collect()}
    assert len(rows) == 4
    for f in (0, 1):
        assert rows["good", f].roc_auc == pytest.approx(brute_auc(pdf[pdf.id % 2 == f]), abs=1e-6)
        assert rows["good", f].roc_auc + rows["bad", f].roc_auc == pytest.approx(1, abs=2e-6)
    pair = evaluation.pairwise_models(folds, [("good", "bad")]).first()
    assert (pair.folds_model_a_higher, pair.folds_model_b_higher, pair.folds_equal) == (2, 0, 0)
    assert [r.pr_auc_rank for r in evaluation.model_summary(folds).orderBy("pr_auc_rank").collect()] == [1, 2]
