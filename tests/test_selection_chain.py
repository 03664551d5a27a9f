"""The selection over all numeric features, and the importance of a boosted model against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import boosting, importance
from holdfast.operators.boosting import BoostParams, Fit
from holdfast.plans import selection_chain as chain
from holdfast.session import materialise
from holdfast.sources.panel import panel

SF = "/root/testdata/sf0.001"


def auc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    return ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg))


def test_importance_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < (0.8 if i % 5 > 2 else 0.2)), i % 4 + 1, float(i % 5), float(rng.integers(9)), 1.0) for i in range(600)]
    m = materialise(spark.createDataFrame(rows, "id long, label int, fold int, useful double, noise double, constant double"))
    columns = ["useful", "noise", "constant"]
    model = boosting.fit_models(m, columns, [Fit("x", BoostParams(20, 0.3, leaves=6, min_rows=5))])
    got = {r.feature: r for r in importance.tree_importance(m, model, repeats=2).collect()}
    nodes = model.nodes().toPandas()
    trees = [{k: g.sort_values("node")[k].to_numpy() for k in ("feature", "cut", "left", "value")} for t, g in nodes.groupby("tree") if t > 0]
    x = np.array([[np.searchsorted(e, r[3 + j]) for j, e in enumerate(model.edges)] for r in rows], np.uint8)
    y = np.array([r[1] for r in rows])
    start = nodes[nodes.tree == 0].value.iloc[0]
    score = lambda z: start + sum(boosting.leaf_values(z, t) for t in trees)
    for j, c in enumerate(columns):
        drops = []
        for repeat in range(2):
            order = [r.id for r in m.orderBy(F.xxhash64(F.lit(importance.SEED + repeat), F.col("id")), "id").select("id").collect()]
            z = x.copy()
            z[:, j] = x[order, j]
            drops.append(auc(score(x), y) - auc(score(z), y))
        assert got[c].importance == pytest.approx(np.mean(drops), abs=2e-4)
    assert got["useful"].importance_rank == 1 and got["constant"].importance == 0


def test_chain_goes_over_all_numeric_features(spark, monkeypatch):
    monkeypatch.setattr(chain, "SELECTION_TREES", BoostParams(10, 0.2, leaves=6, min_rows=5, min_hessian=1e-3))
    monkeypatch.setattr(chain.trained, "baseline_settings", lambda: {"XGBoost": BoostParams(5, 0.3, 3)})
    p = materialise(panel(spark, SF))
    names = chain.candidates(p)
    assert len(names) > 320 and {"aon", "arpu_avg_6_8", "fb_user_8_missing", "total_activity_trend_score"} <= set(names)
    picks = chain.representatives(p).collect()
    excluded = {r.feature for r in picks if r.decision == "Exclude"}
    left = chain.not_redundant(p)
    assert set(left) == set(names) - excluded and excluded
    pairs = {(r.feature_1, r.feature_2) for r in chain.pairs(p).filter(F.col("abs_spearman_correlation") >= chain.REDUNDANT).collect()}
    group = {r.feature: r.group_id for r in chain.groups(p).collect()}
    assert all(group[a] == group[b] for a, b in pairs)
    info = {r.feature: r for r in chain.information(p).collect()}
    assert set(info) == set(left) and sorted(r.mi_rank for r in info.values()) == list(range(1, len(left) + 1))
    selected = chain.selected(p).collect()
    assert {r.feature for r in selected} == set(chain.informative(p))
    kept = chain.kept(p)
    assert kept and sum(r.feature_count for r in chain.exported(p).collect()) == len(kept)
    assert chain.holdout_of_selected(p).first().model == "XGBoost"
