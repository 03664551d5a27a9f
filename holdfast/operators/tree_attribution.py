"""Path-dependent Shapley values of boosted trees, in log-odds.

A leaf is reached when every feature of its path lies in an interval. A feature that is not known passes with the share of
training rows (cover) that took the path's turns on it. With m features on a path, the Shapley value of one of them sums, over the
subsets of the others, products of "inside or not" and of those shares; the subsets of a size are one coefficient of a polynomial.
Whether a row is inside the intervals is one of 2**m patterns, so a leaf with few features becomes a small table from patterns to
contributions, made once for a model and sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from holdfast.operators.saved_model import SavedModel, margins, matrix_of, prepared
from holdfast.session import ship_package

WIDEST_TABLE = 8
"""Paths with more features are worked out for the patterns that occur."""
CELLS = 400_000
"""Rows x leaves x features in memory at once."""


def leaf_paths(tree: dict[str, np.ndarray]) -> list[tuple[float, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Of each leaf: value, features of its path, their intervals (low, high] and their shares of cover."""
    out, stack = [], [(0, {})]
    while stack:
        i, path = stack.pop()
        f = int(tree["feature"][i])
        if f < 0:
            names = sorted(path)
            low, high, share = (np.array([path[n][k] for n in names]) for k in range(3))
            out.append((float(tree["value"][i]), names, low, high, share))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        left, cut = int(tree["left"][i]), tree["threshold"][i]
        whole = tree["cover"][i]
        for child, one in ((left, (low, min(high, cut))), (left + 1, (max(low, cut), high))):
            part = tree["cover"][child] / whole if whole > 0 else 0.5
            stack.append((child, path | {f: (*one, share * part)}))
    return out


def path_values(inside: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values of the features on paths: ``inside`` (..., m) 0 or 1, ``share`` broadcast to it, ``value`` (...)."""
    m = inside.shape[-1]
    weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
    inside, share = np.broadcast_arrays(inside.astype(np.float64), share)
    out = np.empty(inside.shape)
    for j in range(m):
        poly = [np.ones(inside.shape[:-1])]
        for i in range(m):
            if i != j:
                z, o = share[..., i], inside[..., i]
                poly = [z * poly[0], *[z * poly[k] + o * poly[k - 1] for k in range(1, len(poly))], o * poly[-1]]
        out[..., j] = value * (inside[..., j] - share[..., j]) * sum(w * e for w, e in zip(weight, poly))
    return out


class Explainer:
    """Contributions of all features to the log-odds of complete rows; with ``base`` they add up to it."""

    def __init__(self, start: float, trees: list[dict[str, np.ndarray]], width: int):
        self.width, self.base = width, start
        self.groups, self.wide = [], []
        by_size: dict[int, list] = {}
        for tree in trees:
            for leaf in leaf_paths(tree):
                self.base += leaf[0] * float(np.prod(leaf[4]))
                by_size.setdefault(len(leaf[1]), []).append(leaf)
        for m, leaves in sorted(by_size.items()):
            if m == 0:
                continue
            if m > WIDEST_TABLE:
                self.wide += leaves
                continue
            value = np.array([x[0] for x in leaves])
            feature, low, high, share = (np.array([x[k] for x in leaves]).reshape(len(leaves), m) for k in range(1, 5))
            pattern = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
            table = path_values(pattern[None], share[:, None, :], value[:, None])
            self.groups.append((feature.astype(np.int64), low, high, table))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n, out = len(x), np.zeros((len(x), self.width))
        for feature, low, high, table in self.groups:
            m = feature.shape[1]
            step = max(1, CELLS // max(1, n * m))
            for a in range(0, len(feature), step):
                f = feature[a : a + step]
                inside = (x[:, f] > low[a : a + step]) & (x[:, f] <= high[a : a + step])
                pattern = inside @ (1 << np.arange(m))
                found = table[np.arange(a, a + len(f))[None, :], pattern]
                at = np.arange(n)[:, None, None] * self.width + f[None]
                out += np.bincount(at.ravel(), found.ravel(), n * self.width).reshape(n, self.width)
        for value, names, low, high, share in self.wide:
            inside = (x[:, names] > low) & (x[:, names] <= high)
            kinds, which = np.unique(inside, axis=0, return_inverse=True)
            out[:, names] += path_values(kinds, share, np.full(len(kinds), value))[which.ravel()]
        return out


def contributions(df: DataFrame, model: SavedModel) -> DataFrame:
    """Long table (id, score, feature, value, contribution, base); score is the raw probability. No shuffle."""
    ship_package(df.sparkSession)
    names = model.columns
    explain = Explainer(model.start, model.trees, len(names))
    shared = df.sparkSession.sparkContext.broadcast((explain, model.start, model.trees))
    rows = prepared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explain_, start, trees = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                x = matrix_of(batch)
                score = 1.0 / (1.0 + np.exp(-margins(x, start, trees)))
                flat = explain_(x).ravel()
                n, k = x.shape
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
                columns = [ids, pa.array(np.repeat(score, k)), pa.array(names * n, pa.string()), pa.array(x.ravel()), pa.array(flat), pa.array(np.full(n * k, explain_.base))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "score", "feature", "value", "contribution", "base"])

    schema = StructType([rows.schema["id"]]).add("score", DoubleType()).add("feature", StringType())
    for c in ("value", "contribution", "base"):
        schema = schema.add(c, DoubleType())
    return rows.mapInArrow(run, schema)


def additivity(long: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Base and contributions of a customer must give the log-odds of the score."""
    sums = long.groupBy("id").agg(F.sum("contribution").alias("sum"), F.first("base").alias("base"), F.first("score").alias("score"))
    gap = F.abs(F.col("base") + F.col("sum") - F.ln(F.col("score") / (1 - F.col("score"))))
    return sums.agg(F.count(F.lit(1)).alias("customers"), F.count_if(gap > tolerance).alias("violations"))
