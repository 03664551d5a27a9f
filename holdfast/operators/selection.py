"""Feature screening and selection: sanity, redundancy, information, stability, importance."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators import columns as whole_columns
from holdfast.operators.missingness import feature_family
from holdfast.operators.quantiles import exact_quantiles, long_values
from holdfast.operators.ranking import HOT_SHARE, grouped_prefix_sums
from holdfast.session import materialise

NEAR_CONSTANT = 0.995
REDUNDANT = 0.95
USEFUL_AUC = 0.55
STABLE_RATE = 0.6
BINS = 10
PROTECTED = ("aon", "arpu_8", "total_rech_amt_8", "total_og_mou_8", "total_ic_mou_8")


def numeric_sanity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing and infinite values, distinct values, largest value share, verdict."""
    entries = ", ".join(f"struct('{c}' AS feature, cast({c} AS double) AS value)" for c in columns)
    counts = df.selectExpr(f"inline(array({entries}))").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("value"), F.col("n")
    groups = counts.groupBy("feature").agg(
        F.sum(n).alias("rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("missing_count"),
        F.coalesce(F.sum(F.when(F.abs(v) == float("inf"), n)), F.lit(0)).alias("infinite_count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.max(n).alias("top"),
    )
    share = ratio("top", "rows")
    verdict = (
        F.when(F.col("unique_count") <= 1, "Constant")
        .when(share >= NEAR_CONSTANT, "Near-constant")
        .otherwise("Usable")
    )
    return groups.select(
        "feature",
        "missing_count",
        "infinite_count",
        "unique_count",
        rounded(share, 6).alias("top_value_share"),
        verdict.alias("screening"),
    )


def _matrix_pairs(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """Upper triangle of the Pearson matrix of a vector column as (feature_1, feature_2, correlation)."""
    spark = vectors.sparkSession
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    pairs = [
        (columns[i], columns[j], float(matrix[i, j]))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
        if matrix[i, j] == matrix[i, j]
    ]
    return spark.createDataFrame(pairs, "feature_1 string, feature_2 string, correlation double")


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all column pairs from one distributed Gram matrix (columns^2 numbers)."""
    return _matrix_pairs(VectorAssembler(inputCols=columns, outputCol="v").transform(df).select("v"), columns)


def missing_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of NULL indicators; a column that is never or always missing has none."""
    flags = df.selectExpr(*[f"cast({c} IS NULL AS double) AS {c}" for c in columns])
    return pearson_pairs(flags, columns).select("feature_1", "feature_2", rounded("correlation", 6).alias("correlation"))


RANKED_AT_ONCE = 64
"""Columns whose ranks share a long table; more are ranked block by block and joined by id."""


def _average_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(id, tie-averaged rank of every column).

    Values are counted, ranked by running sums of the counts, and their ranks go back to
    the rows. A value that many rows of a feature share travels by broadcast (at most HOT_SHARE of
    them a feature), so it makes no hot task; its rows are spread over the join of the others.
    """
    entries = ", ".join(f"struct('{c}' AS feature, cast({c} AS double) AS value)" for c in columns)
    long = rows.selectExpr("id", f"inline(array({entries}))")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    run = grouped_prefix_sums(counts, ["feature"], [F.col("value").asc()], ["n"])
    ranks = materialise(run.withColumn("r", F.col("cum_n") - (F.col("n") - 1) / 2.0).select("feature", "value", "r", "n", "all_n"))
    is_hot = F.col("n") * HOT_SHARE >= F.col("all_n")
    hot = ranks.filter(is_hot).select("feature", "value", F.col("r").alias("_hot"))
    cold = ranks.filter(~is_hot).select("feature", "value", F.lit(0).alias("_salt"), F.col("r").alias("_cold"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.hash("id"), 997) + 1).otherwise(0)
    found = (
        long.join(F.broadcast(hot), ["feature", "value"], "left")
        .withColumn("_salt", salt)
        .join(cold, ["feature", "value", "_salt"], "left")
        .select("id", "feature", F.coalesce("_hot", "_cold").alias("r"))
    )
    return found.groupBy("id").agg(*[F.max(F.when(F.col("feature") == c, F.col("r"))).alias(c) for c in columns])


def _rank_products(rows: DataFrame, columns: list[str], size: int) -> np.ndarray:
    """Products of centred ranks over all ids; the rows of one id count once, with the highest value of each column."""
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return whole_columns.rank_products(rows, columns, size)
    single = materialise(rows.groupBy("id").agg(*[F.max(c).alias(c) for c in columns]))
    return whole_columns.rank_products(rows, columns, size, single)


def _product_pairs(products: np.ndarray, columns: list[str], spark: SparkSession) -> DataFrame:
    """Correlations from sums of products, the last row and column of which are sums; a constant column has none."""
    sums, n = products[:-1, -1], products[-1, -1]
    spread = products[:-1, :-1] - np.outer(sums, sums) / max(n, 1.0)
    scale = np.sqrt(spread.diagonal())
    pairs = [
        (columns[i], columns[j], float(spread[i, j] / (scale[i] * scale[j])))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
        if scale[i] > 0 and scale[j] > 0
    ]
    return spark.createDataFrame(pairs, "feature_1 string, feature_2 string, correlation double")


def spearman_pairs(df: DataFrame, columns: list[str], stored: bool = False) -> DataFrame:
    """Absolute Spearman correlation of complete columns over all rows, from one matrix of ranks.

    Rows of one id count once, with the highest rank of each column. ``stored``: df is read from storage.
    """
    rows = df.select("id", *columns) if stored else materialise(df.select("id", *columns))
    size = rows.count()
    if size <= whole_columns.COLUMN_ROWS:
        pairs = _product_pairs(_rank_products(rows, columns, size), columns, rows.sparkSession)
    else:
        blocks = [columns[i : i + RANKED_AT_ONCE] for i in range(0, len(columns), RANKED_AT_ONCE)]
        wide = _average_ranks(rows, blocks[0])
        for block in blocks[1:]:
            wide = materialise(wide).join(materialise(_average_ranks(rows, block)), "id")
        pairs = pearson_pairs(wide, columns)
    return pairs.select(
        "feature_1", "feature_2", rounded(F.abs("correlation"), 6).alias("abs_spearman_correlation")
    )


def redundancy_groups(pairs: DataFrame, threshold: float = REDUNDANT) -> DataFrame:
    """Connected features of the redundancy graph, by spreading the smallest name.

    The graph has as many nodes as there are features. Each round stores its labels, so the
    lineage stays one step long; it stops when no label changes.
    """
    linked = pairs.filter(F.col("abs_spearman_correlation") >= threshold)
    edges = materialise(
        linked.select(F.col("feature_1").alias("a"), F.col("feature_2").alias("b")).union(
            linked.select(F.col("feature_2").alias("a"), F.col("feature_1").alias("b"))
        )
    )
    labels = materialise(edges.select(F.col("a").alias("feature"), F.col("a").alias("root")).distinct())
    while True:
        heard = edges.join(labels, edges["b"] == labels["feature"]).groupBy("a").agg(F.min("root").alias("heard"))
        spread = materialise(
            labels.join(heard, labels["feature"] == heard["a"]).select(
                "feature",
                F.least("root", "heard").alias("root"),
                (F.col("heard") < F.col("root")).alias("changed"),
            )
        )
        labels = spread.select("feature", "root")
        if spread.filter("changed").isEmpty():
            break
    number = F.dense_rank().over(Window.orderBy("root")).cast("bigint")
    return labels.select("feature", number.alias("group_id"))


# Name fragments of derived features and of business measures.
DERIVED = "change|trend|ratio|baseline|flag|avg_|min_|max_|std_"
BUSINESS = "arpu|aon|total_rech|total_og|total_ic|vol_2g|vol_3g"


def preference(feature: Column, missing_pct: Column) -> Column:
    """Which feature of a redundant group to keep: raw, recent, business-relevant, complete."""
    name = F.lower(feature)
    return (
        F.when(name.rlike(DERIVED), 0.0).otherwise(3.0)
        + F.when(feature.contains("_8"), 2.0).otherwise(0.0)
        + F.when(name.rlike(BUSINESS), 2.0).otherwise(0.0)
        + F.greatest(F.lit(0.0), F.lit(1.0) - missing_pct / 100.0)
    )


def representatives(groups: DataFrame, missing: DataFrame) -> DataFrame:
    """Best-scored feature of each group is kept; equal scores go to the later name."""
    scored = groups.join(missing, "feature").withColumn(
        "score", preference(F.col("feature"), F.col("missing_pct"))
    )
    best = Window.partitionBy("group_id").orderBy(F.desc("score"), F.desc("feature"))
    ranked = scored.withColumns(
        {"place": F.row_number().over(best), "representative": F.first("feature").over(best)}
    )
    kept = F.col("place") == 1
    return ranked.select(
        "group_id",
        "feature",
        F.when(kept, "Retain").otherwise("Exclude").alias("decision"),
        "representative",
        F.when(kept, "Preferred representative of highly correlated group")
        .otherwise("Highly correlated redundant feature")
        .alias("reason"),
    )


def binned_information(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """Mutual information (nats) between the label and each column cut at its exact quantiles.

    NULL is a bin of its own. Only the bin edges are broadcast.
    """
    rows = materialise(df.select("label", *columns))
    cuts = {f"q{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(rows, columns, cuts)
    entries = ", ".join(f"struct('{c}' AS feature, cast({c} AS double) AS value)" for c in columns)
    long = rows.selectExpr("label", f"inline(array({entries}))").join(F.broadcast(edges), "feature", "left")
    place = F.lit(0)
    for q in cuts:
        place = place + F.when(F.col("value") > F.col(q), 1).otherwise(0)
    cells = long.groupBy("feature", F.coalesce(F.when(F.col("value").isNull(), -1), place).alias("bin"), "label").agg(
        F.count(F.lit(1)).alias("n")
    )
    by_bin, by_label, by_all = (Window.partitionBy(*k) for k in (("feature", "bin"), ("feature", "label"), ("feature",)))
    n, whole = F.col("n"), F.sum("n").over(by_all)
    expected = F.sum("n").over(by_bin) * F.sum("n").over(by_label) / whole
    terms = cells.select("feature", (n / whole * F.ln(n / expected)).alias("t"))
    scores = terms.groupBy("feature").agg(rounded(F.sum("t"), 6).alias("mutual_information"))
    order = Window.orderBy(F.desc("mutual_information"), F.asc("feature"))
    return scores.withColumn("mi_rank", F.row_number().over(order).cast("bigint"))


def grouped_auc(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """ROC-AUC of every column in every group: one long count table, one ordered accumulation."""
    keys = ["feature", *by]
    counts = long_values(df, columns, ["label", *by]).groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("pos")
    )
    run = grouped_prefix_sums(counts, keys, [F.col("value").desc()], ["n", "pos"])
    n, pos = F.col("n"), F.col("pos")
    sums = run.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(pos).alias("pos"),
        F.count(F.lit(1)).alias("values"),
        F.sum((n - pos) * (F.col("cum_pos") - pos + pos / 2.0)).alias("pairs"),
    )
    return sums.select(*keys, "values", ratio("pairs", F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc"))


def univariate_stability(df: DataFrame, columns: list[str]) -> DataFrame:
    """Direction-free AUC of each column per fold; stable when most folds reach 0.55."""
    size = df.count()
    if size <= whole_columns.COLUMN_ROWS:
        pairs = whole_columns.group_pairs(df, columns, size, "fold")
        aucs = pairs.select("feature", "fold", ratio("pairs", F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc"))
    else:
        aucs = grouped_auc(df, columns, ["fold"])
    aucs = aucs.filter("auc IS NOT NULL")
    auc = F.greatest("auc", F.lit(1.0) - F.col("auc"))
    folds = aucs.select("feature", rounded(auc, 9).alias("auc"))
    groups = folds.groupBy("feature").agg(
        F.avg("auc").alias("mean"),
        F.stddev_pop("auc").alias("std"),
        F.count_if(F.col("auc") >= USEFUL_AUC).alias("stable_folds"),
        F.count(F.lit(1)).alias("folds"),
    )
    rate = ratio("stable_folds", "folds")
    return groups.select(
        "feature",
        rounded("mean", 6).alias("mean_cv_auc"),
        rounded("std", 6).alias("cv_auc_std"),
        "stable_folds",
        rounded(rate, 6).alias("stability_rate"),
        ((rate >= STABLE_RATE) & (F.col("mean") >= USEFUL_AUC)).alias("stable"),
    )


def final_selection(
    stability: DataFrame, importance: DataFrame, excluded: DataFrame | None = None, fallback: int = 30
) -> DataFrame:
    """Keep features with a stable signal, positive importance or business protection.

    Without any survivor the most important ``fallback`` features are kept. ``excluded`` lists
    features an earlier screening already dropped.
    """
    rows = stability.join(importance.select("feature", "importance"), "feature", "left")
    if excluded is not None:
        rows = rows.join(excluded.select("feature").distinct(), "feature", "left_anti")
    keep = F.col("stable") | F.coalesce(F.col("importance") > 0, F.lit(False)) | F.col("feature").isin(*PROTECTED)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("importance"), "feature"))
    marked = rows.withColumns({"keep": keep, "place": place})
    anything = F.bool_or("keep").over(Window.partitionBy())
    retained = F.col("keep") | (~anything & (F.col("place") <= fallback))
    reason = (
        F.when(F.col("keep"), "Survived quality, redundancy and predictive-evidence screening")
        .when(retained, "Fallback retention from model-based predictive ranking")
        .otherwise("Insufficient predictive evidence after stability/model review")
    )
    return marked.select(
        "feature",
        feature_family(F.col("feature")).alias("feature_family"),
        "mean_cv_auc",
        "stability_rate",
        "importance",
        F.when(retained, "Retained").otherwise("Excluded").alias("status"),
        reason.alias("reason"),
    )


def family_summary(register: DataFrame) -> DataFrame:
    return (
        register.filter(F.col("status") == "Retained")
        .groupBy("feature_family")
        .agg(F.count(F.lit(1)).alias("feature_count"))
    )
