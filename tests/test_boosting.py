"""Boosted trees against plain splits, in tasks and in rounds, and what each setting does."""

import numpy as np
import pytest

from holdfast.operators import boosting as b
from holdfast.operators.boosting import BoostParams, Fit


def data(n=600, width=4, seed=0, levels=7):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, width)).astype(np.uint8)
    label = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 1.0 - 3 + (x[:, 1] > 3) * (x[:, 2] < 2) * 2)))).astype(np.int8)
    return x, label, np.arange(n, dtype=np.int64)


def plain_tree(x, g, h, p, bins):
    """Nested tuples (feature, cut, left, right) or leaf values, split by split over all cuts."""

    def best(rows):
        found = None
        for f in range(x.shape[1]):
            for c in range(bins):
                a = rows[x[rows, f] <= c]
                z = rows[x[rows, f] > c]
                if min(len(a), len(z)) < max(p.min_rows, 1) or min(h[a].sum(), h[z].sum()) < p.min_hessian:
                    continue
                worth = lambda r: float(b.soft(np.array(g[r].sum()), p.l1)) ** 2 / max(h[r].sum() + p.l2, 1e-15)
                gain = worth(a) + worth(z) - worth(rows)
                if gain > max(1e-6, p.min_gain) and (found is None or gain > found[0] + 1e-12):
                    found = (gain, f, c, a, z)
        return found

    root = {"rows": np.arange(len(x)), "level": 0}
    leaves = [root]
    while True:
        able = []
        for leaf in leaves:
            if "best" not in leaf:
                leaf["best"] = best(leaf["rows"])
            if leaf["best"] and not (p.depth and leaf["level"] >= p.depth):
                able.append(leaf)
        if not able or (p.leaves and len(leaves) >= p.leaves):
            break
        leaf = max(able, key=lambda one: one["best"][0]) if p.leaves else able[0]
        leaves = [one for one in leaves if one is not leaf]
        leaf["children"] = [{"rows": r, "level": leaf["level"] + 1} for r in leaf["best"][3:]]
        leaves += leaf["children"]

    def shown(node):
        if "children" in node:
            return (node["best"][1], node["best"][2], *[shown(c) for c in node["children"]])
        r = node["rows"]
        return round(float(-p.rate * b.soft(np.array(g[r].sum()), p.l1) / (h[r].sum() + p.l2)), 9)

    return shown(root)


def nested(tree, i=0):
    if tree["feature"][i] < 0:
        return round(float(tree["value"][i]), 9)
    return (int(tree["feature"][i]), int(tree["cut"][i]), nested(tree, tree["left"][i]), nested(tree, tree["left"][i] + 1))


SETTINGS = {
    "levels": BoostParams(3, 0.3, depth=3),
    "best first": BoostParams(3, 0.3, leaves=6, min_rows=20, min_hessian=1e-3, l2=0.0),
    "many leaves": BoostParams(2, 0.3, leaves=25, min_rows=5, min_hessian=1e-3, l2=1.0),
    "penalties": BoostParams(3, 0.1, depth=4, min_hessian=3.0, l2=2.0, l1=0.5, min_gain=0.3),
}


@pytest.mark.parametrize("name", SETTINGS)
def test_trees_equal_plain_splits(name):
    p = SETTINGS[name]
    x, label, ids = data()
    start, trees, margin = b.boost(x, label, ids, np.ones(len(x), bool), p, 7)
    m = np.full(len(x), start)
    assert start == pytest.approx(np.log(label.mean() / (1 - label.mean())))
    for tree in trees:
        g, h = (v / b._UNIT for v in b.gradients(m, label))
        assert nested(tree) == plain_tree(x, g, h, p, 7)
        m = m + b.leaf_values(x, tree)
    assert np.allclose(m, margin, atol=1e-12)


def matrix(spark, n=400):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(rng.random() < 0.4), int(i % 6) or None, float(rng.normal()), float(rng.integers(4)), None if i % 50 == 0 else float(rng.exponential())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, fold int, a double, b double, c double")


def trees_of(fitted):
    return sorted(tuple(r) for r in fitted.nodes().collect())


def scores_of(fitted):
    return {(r["model"], r["without"], r["id"]): r["score"] for r in fitted.scores().collect()}


def test_rounds_over_blocks_equal_tasks(spark):
    """The distributed rounds, over another partitioning, give the same trees and scores as one task for each fit."""
    m = matrix(spark)
    fits = [
        Fit("levels", BoostParams(9, 0.3, depth=3, rows=0.8, columns=0.7)),
        Fit("levels", BoostParams(9, 0.3, depth=3, rows=0.8, columns=0.7), 2),
        Fit("best first", BoostParams(4, 0.2, leaves=7, min_rows=9, min_hessian=1e-3, l2=0.0), 1),
    ]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        one = b.fit_models(m, ["a", "b", "c"], fits)
        two = b.fit_models(m.repartition(3), ["a", "b", "c"], fits, task_cells=0)
        assert trees_of(one) == trees_of(two)
        left, right = scores_of(one), scores_of(two)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert left == pytest.approx(right, abs=1e-12)
    assert len(left) == 3 * 400


def test_a_fold_left_out_teaches_nothing(spark):
    m = matrix(spark)
    flipped = m.withColumn("label", b.F.expr("CASE WHEN fold = 2 OR fold IS NULL THEN 1 - label ELSE label END"))
    fits = [Fit("x", BoostParams(5, 0.3, depth=3), 2)]
    assert trees_of(b.fit_models(m, ["a", "b", "c"], fits)) == trees_of(b.fit_models(flipped, ["a", "b", "c"], fits))


def test_every_setting_has_an_effect():
    x, label, ids = data(n=900)
    base = BoostParams(12, 0.2, depth=4)
    seen = np.ones(len(x), bool)
    margins = [b.boost(x, label, ids, seen, p, 7)[2] for p in (base, BoostParams(12, 0.2, depth=4, l2=2.0), BoostParams(12, 0.2, depth=4, l1=0.2), BoostParams(12, 0.2, depth=4, min_gain=1.5), BoostParams(12, 0.2, depth=4, min_hessian=8), BoostParams(12, 0.2, depth=4, min_rows=60), BoostParams(12, 0.2, depth=4, rows=0.7), BoostParams(12, 0.2, depth=4, columns=0.5), BoostParams(12, 0.2, leaves=9))]
    for i, one in enumerate(margins):
        for two in margins[:i]:
            assert not np.allclose(one, two)


def test_one_class_and_constant_columns(spark):
    rows = [(i, 0, 1 + i % 2, 1.0, None) for i in range(30)]
    m = spark.createDataFrame(rows, "id long, label int, fold int, a double, b double")
    fitted = b.fit_models(m, ["a", "b"], [Fit("x", BoostParams(2, 0.1, depth=2))])
    assert all(0 <= s < 1e-5 for s in scores_of(fitted).values())
    empty = b.fit_models(m.limit(0), ["a", "b"], [Fit("x", BoostParams(2, 0.1, depth=2))])
    assert empty.scores().count() == 0


@pytest.mark.parametrize("name", SETTINGS)
def test_only_the_smaller_child_is_added_up(name, monkeypatch):
    """Rows added up for a tree: all of them for the root, at most half of a node for its two children."""
    x, label, ids = data(n=3000, levels=40)
    added, real = [], b.node_sums
    monkeypatch.setattr(b, "node_sums", lambda x, columns, rows, *rest: added.append(len(rows)) or real(x, columns, rows, *rest))
    _, trees, _ = b.boost(x, label, ids, ids % 5 > 0, SETTINGS[name], 40)
    levels = max(SETTINGS[name].depth, SETTINGS[name].leaves)
    assert added.count(2400) == len(trees)
    assert sum(added) <= len(trees) * 2400 * (1 + levels / 2)


def test_sums_of_long_nodes_are_exact():
    """More rows than are added up at a time, the largest Hessian, an odd number of rows and a column left out."""
    n = 3 * b._PART + 5
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (3, n)).astype(np.uint8)
    g = np.rint(rng.uniform(-1, 1, n) * b._UNIT)
    h = np.full(n, b._UNIT / 4)
    rows = np.flatnonzero(rng.random(n) < 0.9)
    for some in (rows, rows[:100], rows[:0]):
        got = b.node_sums(x, np.array([0, 2]), some, g, h * 2 * b._PART + 1, 9)
        for j, column in enumerate((0, 2)):
            for k, weights in enumerate((g, h, np.ones(n))):
                want = [int(weights[some][x[column][some] == c].sum()) for c in range(9)]
                assert got[k, j].astype(int).tolist() == want


def test_a_matrix_of_nine_hundred_thousand_customers_fits_a_task():
    assert 900_000 * (24 + b.ROW_STATE) <= b.TASK_CELLS
