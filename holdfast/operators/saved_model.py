"""A trained model as a published file: trees, fill values and calibration; loaded, checked against a table, and applied to it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from holdfast.functions.numeric import rounded
from holdfast.operators.scoring import PRIMARY_THRESHOLD, MissingFeatures, Sigmoid, risk_level
from holdfast.session import ship_package
from holdfast.sources.published import publish, read_published

NODE = ("tree", "node", "feature", "threshold", "left", "value", "cover")


class WrongType(TypeError):
    """A column of the table to score has not the type that the model was fitted on."""


@dataclass(frozen=True)
class SavedModel:
    """Features in order with their types and fill values, the start value, the trees and the calibration."""

    types: dict[str, str]
    medians: dict[str, float]
    sigmoid: Sigmoid
    start: float
    trees: list[dict[str, np.ndarray]]

    @property
    def columns(self) -> list[str]:
        return list(self.types)


def trees_of(nodes: DataFrame) -> tuple[float, list[dict[str, np.ndarray]]]:
    """Start value and trees of one model's node table; trees x leaves rows, which the model's settings bound."""
    rows = sorted(tuple(r) for r in nodes.select(*NODE).collect())
    start, trees = 0.0, []
    for tree, _, feature, threshold, left, value, cover in rows:
        if tree == 0:
            start = value
            continue
        if tree > len(trees):
            trees.append({k: [] for k in NODE[2:]})
        for k, v in zip(NODE[2:], (feature, np.nan if threshold is None else threshold, left, value, cover)):
            trees[-1][k].append(v)
    return start, [{k: np.array(v, np.int64 if k in ("feature", "left") else np.float64) for k, v in t.items()} for t in trees]


def save(nodes: DataFrame, types: dict[str, str], medians: dict[str, float], sigmoid: Sigmoid, path: str) -> None:
    """Publish a model; its description comes last, so a reader never meets half a model."""
    publish(nodes.select(*NODE), f"{path}/nodes", replace=True)
    text = json.dumps({"types": types, "medians": medians, "sigmoid": [sigmoid.slope, sigmoid.intercept]})
    publish(nodes.sparkSession.createDataFrame([(text,)], "model string"), f"{path}/description")


def load(spark: SparkSession, path: str) -> SavedModel:
    known = json.loads(read_published(spark, f"{path}/description").first()["model"])
    start, trees = trees_of(read_published(spark, f"{path}/nodes"))
    return SavedModel(known["types"], known["medians"], Sigmoid(*known["sigmoid"]), start, trees)


def prepared(df: DataFrame, model: SavedModel) -> DataFrame:
    """``id`` and the model's features in order, complete; a label is not needed.

    Missing columns or columns of another type are refused; a missing value takes the development median; an infinite one
    stops the job.
    """
    absent = [c for c in model.columns if c not in df.columns]
    if absent:
        raise MissingFeatures(", ".join(absent))
    found = dict(df.dtypes)
    wrong = [f"{c}: {found[c]}, fitted on {t}" for c, t in model.types.items() if found[c] != t]
    if wrong:
        raise WrongType("; ".join(wrong))

    def filled(c: str):
        x = F.col(c).cast("double")
        whole = F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(model.medians[c]))
        infinite = F.raise_error(F.lit(f"infinite value of {c}")).cast("double")
        return F.when(F.abs(whole) == float("inf"), infinite).otherwise(whole).alias(c)

    return df.select("id", *[filled(c) for c in model.columns])


def margins(x: np.ndarray, start: float, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Log-odds of complete rows, summed in the order of the trees."""
    out = np.full(len(x), start)
    for t in trees:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[t["feature"][at[rows]] >= 0]):
            now = at[rows]
            at[rows] = t["left"][now] + (x[rows, t["feature"][now]] > t["threshold"][now])
        out += t["value"][at]
    return out


def matrix_of(batch: pa.RecordBatch, first: int = 1) -> np.ndarray:
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]]
    return np.stack(columns, axis=1).astype(np.float64) if columns else np.zeros((batch.num_rows, 0))


def raw_probability(df: DataFrame, model: SavedModel) -> DataFrame:
    """(id, raw_probability) of every row; a projection in Arrow batches, no shuffle."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.start, model.trees))
    rows = prepared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = margins(matrix_of(batch), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-z)))], ["id", "raw_probability"])

    return rows.mapInArrow(run, StructType([rows.schema["id"]]).add("raw_probability", DoubleType()))


def batch_score(df: DataFrame, model: SavedModel, primary: float = PRIMARY_THRESHOLD) -> DataFrame:
    """Raw and calibrated probability, risk level and whether it reaches the primary threshold, of any number of rows."""
    rows = raw_probability(df, model)
    calibrated = rounded(model.sigmoid.apply(F.col("raw_probability")), 6)
    return rows.withColumn("calibrated_probability", calibrated).select(
        "id",
        rounded("raw_probability", 6).alias("raw_probability"),
        "calibrated_probability",
        risk_level(F.col("calibrated_probability"), primary).alias("risk_level"),
        (F.col("calibrated_probability") >= primary).alias("above_primary_threshold"),
    )
