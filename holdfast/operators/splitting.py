"""Deterministic stratified splits and folds.

Rows are ordered inside each label by an arithmetic key, so the same customers land in the same
split on every run and on every cluster size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ranking import grouped_rank

DEVELOPMENT_SHARE = 0.8
FOLDS = 5
SPLIT_KEY = "(id * 7919 + 104729) % 1000003"
DEVELOPMENT, VALIDATION = "development", "validation"


def stratified_rank(df: DataFrame) -> DataFrame:
    keyed = df.withColumn("_key", F.expr(SPLIT_KEY))
    return grouped_rank(keyed, ["label"], [F.col("_key").asc(), F.col("id").asc()], "_rank", "_size").drop("_key")


def with_split(df: DataFrame, share: float = DEVELOPMENT_SHARE) -> DataFrame:
    """Add ``split``: the first ``share`` of every label is development, the rest validation."""
    percent = math.floor(share * 100 + 0.5)
    cut = F.ceil(F.col("_size") * percent / 100.0)
    name = F.when(F.col("_rank") <= cut, DEVELOPMENT).otherwise(VALIDATION)
    return stratified_rank(df).withColumn("split", name).drop("_rank", "_size")


def join_split(df: DataFrame, share: float = DEVELOPMENT_SHARE) -> DataFrame:
    """Add ``split`` to a wide table: only (id, label) is sorted, the rest joins on the id."""
    return df.join(with_split(df.select("id", "label"), share).select("id", "split"), "id")


def with_fold(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Add ``fold`` 1..k, dealt out in turn inside every label."""
    return (
        stratified_rank(df)
        .withColumn("fold", ((F.col("_rank") - 1) % folds + 1).cast("int"))
        .drop("_rank", "_size")
    )


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, churners and rate per split, and how many ids appear in more than one."""
    from holdfast.functions.numeric import percent

    parts = with_split(df.select("id", "label"))
    return parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("id").alias("distinct_ids"),
        F.sum("label").alias("churners"),
        percent(F.sum("label"), F.count(F.lit(1)), 6).alias("churn_rate_pct"),
    )
