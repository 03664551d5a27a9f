"""Training on the customer matrix with spark.ml: logistic regression and gradient-boosted trees."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.features import build_features, impute
from holdfast.operators.metrics import rank_metrics
from holdfast.operators.quantiles import medians_wide
from holdfast.operators.splitting import DEVELOPMENT, FOLDS, VALIDATION, join_split, with_fold
from holdfast.session import materialise

SEED = 42
MODEL_FEATURES = (
    "aon",
    "arpu_7",
    "arpu_8",
    "total_rech_amt_7",
    "total_rech_amt_8",
    "total_rech_num_7",
    "total_rech_num_8",
    "max_rech_amt_8",
    "total_og_mou_8",
    "total_ic_mou_8",
    "onnet_mou_8",
    "offnet_mou_8",
    "voice_rech_recency_8",
    "arpu_avg_6_8",
    "arpu_std_6_8",
    "arpu_change_7_to_8",
    "recharge_amount_min_6_8",
    "recharge_amt_change_6_to_8",
    "total_og_mou_change_7_to_8",
    "total_ic_mou_change_7_to_8",
    "recharge_count_trend_score",
    "behavioral_decline_count",
    "no_recharge_count_8",
    "total_voice_mou_8",
)


def feature_rows(panel: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """(id, label, split, features) with missing values still missing; stored once."""
    return materialise(join_split(build_features(panel).select("id", "label", *columns)))


def development_medians(rows: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """Exact medians fitted on development rows alone."""
    return medians_wide(rows.filter(F.col("split") == DEVELOPMENT), list(columns), in_tasks=True)


def model_matrix(
    panel: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES, folds: int = FOLDS
) -> DataFrame:
    """Complete feature rows keyed by id with split and, for development rows, one of ``folds`` folds."""
    rows = feature_rows(panel, columns)
    filled = impute(rows, development_medians(rows, columns), list(columns))
    dealt = with_fold(rows.filter(F.col("split") == DEVELOPMENT).select("id", "label"), folds)
    return materialise(filled.join(dealt.select("id", "fold"), "id", "left"))


@dataclass(frozen=True)
class TreeParams:
    iterations: int = 20
    step: float = 0.1
    depth: int = 4
    leaf: int = 10
    subsample: float = 1.0
    columns: str = "all"
    bins: int = 32


def logistic(columns: tuple[str, ...], rows: int, c: float = 1.0, iterations: int = 100) -> Pipeline:
    """Standardised L2 logistic regression; c is the inverse penalty per row, as usual elsewhere."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(
                labelCol="label",
                regParam=1.0 / (c * max(rows, 1)),
                maxIter=iterations,
                standardization=False,
            ),
        ]
    )


def boosted_trees(columns: tuple[str, ...], params: TreeParams = TreeParams()) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="features"),
            GBTClassifier(
                labelCol="label",
                maxIter=params.iterations,
                stepSize=params.step,
                maxDepth=params.depth,
                minInstancesPerNode=params.leaf,
                subsamplingRate=params.subsample,
                featureSubsetStrategy=params.columns,
                maxBins=params.bins,
                seed=SEED,
            ),
        ]
    )


def predict(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """(model, id, label, score)"""
    scored = model.transform(rows)
    return scored.select(
        F.lit(name).alias("model"), "id", "label", vector_to_array("probability")[1].alias("score")
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class CrossValidation:
    """Out-of-fold and training scores, as (model, fold, id, label, score)."""

    held_out: DataFrame
    training: DataFrame


PARALLEL_FITS = 4
"""Fits submitted at the same time; each is a distributed job of its own with many short stages."""


def fit_all(tasks: list[tuple[Estimator, DataFrame]], parallel: int = PARALLEL_FITS) -> list[PipelineModel]:
    """Fit (estimator, rows) pairs, a few at a time, from driver threads as Spark's own tuning does."""
    session = tasks[0][1].sparkSession
    with ThreadPool(min(parallel, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(session)(lambda task: task[0].fit(task[1])), tasks)


def cross_validate(matrix: DataFrame, estimators: dict[str, Estimator], folds: int = FOLDS) -> CrossValidation:
    """Fit every model on every fold complement; ``folds`` is the number the matrix was dealt into."""
    cells = [(fold, name) for fold in range(1, folds + 1) for name in estimators]
    rest = {fold: matrix.filter(F.col("fold") != fold) for fold in range(1, folds + 1)}
    models = fit_all([(estimators[name], rest[fold]) for fold, name in cells])
    held_out, training = [], []
    for (fold, name), model in zip(cells, models):
        out = matrix.filter(F.col("fold") == fold)
        held_out.append(predict(model, out, name).withColumn("fold", F.lit(fold)))
        training.append(predict(model, rest[fold], name).withColumn("fold", F.lit(fold)))
    return CrossValidation(materialise(union_all(held_out)), materialise(union_all(training)))


def holdout_scores(matrix: DataFrame, estimators: dict[str, Estimator]) -> DataFrame:
    """Fit on all development rows, score the validation rows."""
    dev, val = (matrix.filter(F.col("split") == s) for s in (DEVELOPMENT, VALIDATION))
    models = fit_all([(e, dev) for e in estimators.values()])
    return materialise(union_all([predict(m, val, name) for name, m in zip(estimators, models)]))


def coefficients(model: PipelineModel, columns: tuple[str, ...], matrix: DataFrame) -> DataFrame:
    """Coefficients of a fitted logistic pipeline with their reading."""
    weights = model.stages[-1].coefficients.toArray()
    rows = [(c, float(w)) for c, w in zip(columns, weights)]
    text = (
        F.when(F.col("coefficient") > 0, "Higher feature value associated with higher churn probability")
        .when(F.col("coefficient") < 0, "Higher feature value associated with lower churn probability")
        .otherwise("No directional association")
    )
    return matrix.sparkSession.createDataFrame(rows, "feature string, coefficient double").select(
        "feature", "coefficient", F.abs("coefficient").alias("absolute_coefficient"), text.alias("direction")
    )


def audit(matrix: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES, threshold: float = 0.5) -> DataFrame:
    """(check, value) rows describing a model matrix, from one aggregate."""
    dev, val = F.col("split") == DEVELOPMENT, F.col("split") == VALIDATION
    missing = " + ".join(f"int({c} IS NULL)" for c in columns)
    infinite = " + ".join(f"int(coalesce(abs({c}) = double('infinity'), false))" for c in columns)
    churn = F.col("label") == 1
    sums = matrix.agg(
        F.count_if(dev).alias("d"),
        F.count_if(val).alias("v"),
        F.count_if(dev & churn).alias("dc"),
        F.count_if(val & churn).alias("vc"),
        F.sum(F.when(dev, F.expr(missing)).otherwise(0)).alias("dm"),
        F.sum(F.when(val, F.expr(missing)).otherwise(0)).alias("vm"),
        F.sum(F.when(dev, F.expr(infinite)).otherwise(0)).alias("di"),
        F.sum(F.when(val, F.expr(infinite)).otherwise(0)).alias("vi"),
    )
    shown = {
        "feature_count": F.lit(float(len(columns))),
        "development_rows": F.col("d").cast("double"),
        "validation_rows": F.col("v").cast("double"),
        "development_churn_rate": rounded(ratio("dc", "d"), 6),
        "validation_churn_rate": rounded(ratio("vc", "v"), 6),
        "class_ratio_majority_to_minority": rounded(
            ratio(F.greatest("dc", F.col("d") - F.col("dc")), F.least("dc", F.col("d") - F.col("dc"))), 6
        ),
        "initial_threshold": F.lit(float(threshold)),
        "random_state": F.lit(float(SEED)),
        "development_missing_values": F.col("dm").cast("double"),
        "validation_missing_values": F.col("vm").cast("double"),
        "development_infinite_values": F.col("di").cast("double"),
        "validation_infinite_values": F.col("vi").cast("double"),
    }
    entries = [F.struct(F.lit(k).alias("check"), c.alias("value")) for k, c in shown.items()]
    return sums.select(F.inline(F.array(*entries)))


def dummy_scores(rows: DataFrame) -> DataFrame:
    """Validation rows scored by the development majority class and by its churn rate."""
    rate = rows.filter(F.col("split") == DEVELOPMENT).groupBy(F.lit(1).alias("_one")).agg(F.avg("label").alias("_rate"))
    val = (
        rows.filter(F.col("split") == VALIDATION)
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(rate), "_one")
        .select(
            "id",
            "label",
            F.inline(
                F.array(
                    F.struct(
                        F.lit("Most Frequent").alias("model"),
                        F.when(F.col("_rate") > 0.5, 1.0).otherwise(0.0).alias("score"),
                    ),
                    F.struct(F.lit("Prior Probability").alias("model"), rounded("_rate", 6).alias("score")),
                )
            ),
        )
    )
    return val.select("model", "id", "label", "score")


def fingerprint(df: DataFrame) -> DataFrame:
    """Hash of the schema and an order-free hash of the content, to compare two copies of a table.

    A row's hash is the first 60 bits of the MD5 of its values as text, which other engines can repeat.
    """
    schema = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in sorted(df.columns)])
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.first(F.sha2(F.lit(schema), 256)).alias("schema_hash"),
        F.bit_xor(row).alias("content_xor"),
        F.sum(F.pmod(row, F.lit(1_000_003))).alias("content_sum"),
    )


SWAPPED_AT_ONCE = 12
"""Features whose shuffled variants are scored in one pass."""


def permutation_importance(
    model: PipelineModel, rows: DataFrame, columns: tuple[str, ...], repeats: int = 5
) -> DataFrame:
    """Mean and deviation of the ROC-AUC drop when one column is shuffled.

    Shuffling pairs the rows in key order with the rows in a hashed order of the same length, so
    a column keeps its exact distribution. All columns of a repeat share the two orders. Each row is
    laid out once for each feature of a chunk, with that feature swapped, and a chunk is scored as one table.
    """
    from pyspark.sql import Window

    from holdfast.operators.ranking import global_rank
    from holdfast.operators.selection import grouped_auc

    base = materialise(rows.select("id", "label", *columns))
    placed = materialise(global_rank(base, [F.col("id").asc()], "_place", "_n").drop("_n"))
    paired = []
    for r in range(repeats):
        key = F.xxhash64(F.lit(SEED + r), F.col("id"))
        other = global_rank(base, [key.asc(), F.col("id").asc()], "_place", "_n").select(
            "_place", *[F.col(c).alias(f"_o_{c}") for c in columns]
        )
        paired.append(placed.join(other, "_place").withColumn("repeat", F.lit(r)))
    pairs = materialise(union_all(paired))

    def aucs(table: DataFrame, by: list[str]) -> DataFrame:
        scored = model.transform(table).withColumn("score", vector_to_array("probability")[1])
        return materialise(grouped_auc(scored.select("label", "score", *by), ["score"], by).select(*by, "auc"))

    full = aucs(base.withColumn("model", F.lit("all")), ["model"]).first()["auc"]
    parts = []
    for i in range(0, len(columns), SWAPPED_AT_ONCE):
        variants = [
            F.struct(F.lit(c).alias("swapped"), *[F.col(f"_o_{x}" if x == c else x).alias(x) for x in columns])
            for c in columns[i : i + SWAPPED_AT_ONCE]
        ]
        parts.append(aucs(pairs.select("label", "repeat", F.inline(F.array(*variants))), ["swapped", "repeat"]))
    drops = union_all(parts).select(F.col("swapped").alias("feature"), (F.lit(full) - F.col("auc")).alias("drop"))
    means = drops.groupBy("feature").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))
    place = F.rank().over(Window.orderBy(F.desc("mean")))
    return means.select(
        "feature",
        rounded("mean", 6).alias("importance"),
        rounded("std", 6).alias("importance_std"),
        place.cast("bigint").alias("importance_rank"),
    )
