"""Permutation importance of a boosted model: the loss of ROC-AUC when one feature is shuffled over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.boosting import Boosted, leaf_values
from holdfast.operators.modelling import SEED
from holdfast.operators.ranking import global_rank
from holdfast.session import materialise, ship_package

STEPS = 65_536
"""Equal steps of probability that scores are counted in, so that the counts of a shuffled feature are bounded."""


def _binned(matrix: DataFrame, model: Boosted) -> DataFrame:
    """(id, label, x): one byte for the bin of each feature."""
    ship_package(matrix.sparkSession)
    shared = matrix.sparkSession.sparkContext.broadcast(model.edges)
    rows = matrix.select("id", "label", *[F.col(c).cast("double") for c in model.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, len(shared.value)), np.uint8)
            for j, cuts in enumerate(shared.value):
                x[:, j] = np.searchsorted(cuts, batch.column(2 + j).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, x binary")


def _auc(counts: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC of (by, step, n, pos); steps of a group are at most STEPS rows."""
    below = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    n, pos = F.col("n"), F.col("pos")
    under = F.coalesce(F.sum(n - pos).over(below), F.lit(0))
    pairs = counts.withColumn("_w", pos * (under + (n - pos) / 2.0))
    sums = pairs.groupBy(*by).agg(F.sum("_w").alias("w"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select(*by, ratio("w", F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def tree_importance(matrix: DataFrame, model: Boosted, fit: int = 0, repeats: int = 5) -> DataFrame:
    """Mean and deviation over ``repeats`` of the drop of ROC-AUC for each feature, and its rank.

    A shuffle pairs the rows in order of their ids with the rows in a hashed order, so that a column keeps its exact
    distribution; all features of a repeat share the two orders. Only trees that use a feature are walked again for it.
    """
    nodes = model.nodes().filter(F.col("fit") == fit).orderBy("tree", "node").toPandas()  # trees x leaves rows
    start = float(nodes[nodes.tree == 0].value.iloc[0])
    trees = [{k: g[k].to_numpy() for k in ("feature", "cut", "left", "value")} for t, g in nodes[nodes.tree > 0].groupby("tree")]
    used = [sorted({int(f) for f in t["feature"] if f >= 0}) for t in trees]
    width = len(model.columns)
    placed = materialise(global_rank(materialise(_binned(matrix, model)), [F.col("id").asc()], "_place", "_n").drop("_n"))
    pairs = None
    for r in range(repeats):
        other = global_rank(placed.select("id", F.col("x").alias("o")), [F.xxhash64(F.lit(SEED + r), F.col("id")).asc(), F.col("id").asc()], "_place", "_n")
        one = placed.join(other.select("_place", "o"), "_place").select(F.lit(r).alias("repeat"), "label", "x", "o")
        pairs = one if pairs is None else pairs.union(one)
    shared = matrix.sparkSession.sparkContext.broadcast((start, trees, used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_, trees_, used_ = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                x, o = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in (2, 3))
                label, repeat = batch.column(1).to_numpy(), batch.column(0).to_numpy()
                parts = [leaf_values(x, t) for t in trees_]
                base = start_ + sum(parts) if parts else np.full(len(x), start_)
                scores, names = [base], [-1]
                for j in range(width):
                    mine = [k for k, u in enumerate(used_) if j in u]
                    if not mine:
                        continue
                    swapped = x.copy()
                    swapped[:, j] = o[:, j]
                    scores.append(base + sum(leaf_values(swapped, trees_[k]) - parts[k] for k in mine))
                    names.append(j)
                step = np.minimum((STEPS / (1 + np.exp(-np.stack(scores)))).astype(np.int64), STEPS - 1)
                key = (np.repeat(np.arange(len(names)), len(x)) * 64 + np.tile(repeat, len(names))) * STEPS + step.ravel()
                kinds, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, minlength=len(kinds))
                pos = np.bincount(at, np.tile(label, len(names)), len(kinds)).astype(np.int64)
                feature = np.array(names)[kinds // STEPS // 64]
                columns = [feature, kinds // STEPS % 64, kinds % STEPS, n, pos]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["j", "repeat", "step", "n", "pos"])

    counted = pairs.mapInArrow(run, "j long, repeat long, step long, n long, pos long")
    counts = counted.groupBy("j", "repeat", "step").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    aucs = materialise(_auc(counts, ["j", "repeat"]))
    full = aucs.filter("j < 0").select("repeat", F.col("auc").alias("full"))
    drops = aucs.filter("j >= 0").join(F.broadcast(full), "repeat").select("j", (F.col("full") - F.col("auc")).alias("drop"))
    means = drops.groupBy("j").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))
    names = matrix.sparkSession.createDataFrame(list(enumerate(model.columns)), "j long, feature string")
    out = names.join(means, "j", "left").fillna(0.0, ["mean", "std"])  # a feature that no tree uses changes nothing
    return out.select(
        "feature",
        rounded("mean", 6).alias("importance"),
        rounded("std", 6).alias("importance_std"),
        F.rank().over(Window.orderBy(F.desc("mean"))).cast("bigint").alias("importance_rank"),
    )
