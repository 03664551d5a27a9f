"""Exact interpolated quantiles of many columns at once, without a per-column sort or one big task.

Spark's exact percentile keeps every distinct value of a column in one aggregation buffer. Here the
columns go into one long (feature, value) table, equal values are counted, and the middle values
are found by their running counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators import columns as whole_columns
from holdfast.operators.ranking import grouped_prefix_sums


def long_values(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(kept columns, feature, value) rows of the non-null values, from one pass."""
    entries = ", ".join(f"struct('{c}' AS feature, cast({c} AS double) AS value)" for c in columns)
    return df.selectExpr(*(keep or []), f"inline(array({entries}))").filter("value IS NOT NULL")


def exact_quantiles(
    df: DataFrame, columns: list[str], quantiles: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """One row per (group, feature) with a column for every named quantile."""
    keys = [*(by or []), "feature"]
    counts = long_values(df, columns, by).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    placed = grouped_prefix_sums(counts, keys, [F.col("value").asc()], ["n"])
    last, first = F.col("cum_n"), F.col("cum_n") - F.col("n") + 1
    aggs, shown = [], []
    for name, q in quantiles.items():
        at = (F.col("all_n") - 1) * F.lit(float(q))
        low, high = F.floor(at) + 1, F.ceil(at) + 1
        aggs += [
            F.max(F.when((low >= first) & (low <= last), F.col("value"))).alias(f"_lo_{name}"),
            F.max(F.when((high >= first) & (high <= last), F.col("value"))).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_w_{name}"),
        ]
        lo, hi, w = (F.col(f"_{x}_{name}") for x in ("lo", "hi", "w"))
        shown.append((lo + (hi - lo) * w).alias(name))
    return placed.groupBy(*keys).agg(*aggs).select(*keys, *shown)


def medians(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact medians: (group, feature, median)."""
    return exact_quantiles(df, columns, {"median": 0.5}, by)


def medians_wide(df: DataFrame, columns: list[str], by: list[str] | None = None, in_tasks: bool = False) -> DataFrame:
    """Exact medians with one column per feature, named after it; ``in_tasks``: each column of a stored table by one task, if it fits."""
    one = F.lit(1).alias("_one")
    size = df.count() if in_tasks and not by else None
    if size is not None and size <= whole_columns.COLUMN_ROWS:
        long = whole_columns.quantiles(df, columns, size, {"median": 0.5})
    else:
        long = medians(df, columns, by)
    grouped = long.groupBy(*(by or [one])) if by else long.withColumn("_one", F.lit(1)).groupBy("_one")
    return grouped.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in columns])
