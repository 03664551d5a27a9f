"""Summaries of numbers by period that can be stored, added up and compared without the rows they came from.

A number falls into a bucket of fixed width on a logarithmic scale, so that a bucket's middle is within one percent of it; buckets do not
depend on the data. Counts by (feature, period, bucket) add up over periods, tables and clusters. Quantiles and shares of any range
of periods come from the added counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.monitoring import SHARE_FLOOR

GROWTH = 1.02
"""Width of a bucket: the ratio of its ends."""
SMALLEST = 1e-6
"""Numbers nearer to zero share a bucket with it."""
SHIFT = 700
"""Keeps bucket numbers of one sign apart from zero: ln(SMALLEST) / ln(GROWTH) is -697.7."""


def bucket(x: Column) -> Column:
    """Bucket number in the order of the numbers; 0 around zero."""
    size = (F.floor(F.ln(F.abs(x)) / F.lit(math.log(GROWTH))) + F.lit(SHIFT)).cast("int")
    return F.when(F.abs(x) < SMALLEST, F.lit(0)).when(x > 0, size).otherwise(-size)


def middle(b: Column) -> Column:
    """Middle of a bucket on its scale."""
    size = F.exp((F.abs(b) - F.lit(SHIFT) + F.lit(0.5)) * F.lit(math.log(GROWTH)))
    return F.when(b == 0, F.lit(0.0)).when(b > 0, size).otherwise(-size)


def summary(df: DataFrame, columns: dict[str, str], period: int) -> DataFrame:
    """(feature, period, bucket, n) of the columns; ``columns`` maps feature names to columns; a null bucket counts missing values.

    One pass with partial sums; at most a few thousand rows for each feature, whatever the number of rows.
    """
    entries = ", ".join(f"struct('{f}' AS feature, cast({c} AS double) AS value)" for f, c in columns.items())
    long = df.selectExpr(f"inline(array({entries}))")
    known = F.when(F.col("value").isNotNull() & ~F.isnan("value"), bucket(F.col("value")))
    return long.groupBy("feature", F.lit(period).alias("period"), known.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(stored: DataFrame, first: int, last: int) -> DataFrame:
    """(feature, bucket, n) of a range of periods."""
    return stored.filter(F.col("period").between(first, last)).groupBy("feature", "bucket").agg(F.sum("n").alias("n"))


def quantile(counts: DataFrame, share: float) -> DataFrame:
    """(feature, value): middle of the bucket that holds the quantile of each feature."""
    order = Window.partitionBy("feature").orderBy("bucket")
    run = counts.filter("bucket IS NOT NULL").withColumns({"_upto": F.sum("n").over(order), "_all": F.sum("n").over(Window.partitionBy("feature"))})
    found = run.filter(F.col("_upto") >= F.col("_all") * F.lit(share)).groupBy("feature").agg(F.min("bucket").alias("bucket"))
    return found.select("feature", middle(F.col("bucket")).alias("value"))


def compared(stored: DataFrame, reference: tuple[int, int], current: tuple[int, int], bins: int = 10) -> DataFrame:
    """Missing rates, medians and stability index of two ranges of periods, from their summaries alone.

    Bins of the index are the deciles of the reference by the middle rank of each bucket; a bucket the reference lacks falls into the bin
    of the rank it would have. An index needs values on both sides.
    """
    sides = {"r": merged(stored, *reference), "c": merged(stored, *current)}
    both = sides["r"].select("feature", "bucket", F.col("n").alias("r"), F.lit(0).cast("bigint").alias("c"))
    both = both.union(sides["c"].select("feature", "bucket", F.lit(0).cast("bigint"), "n")).groupBy("feature", "bucket").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    value = F.col("bucket").isNotNull()
    whole, order = Window.partitionBy("feature"), Window.partitionBy("feature").orderBy("bucket")
    placed = both.filter(value).withColumns({"_all": F.sum("r").over(whole), "_upto": F.sum("r").over(order)})
    rank = ratio((F.col("_upto") - F.col("r")) * 2 + F.col("r"), F.col("_all") * 2)
    binned = placed.withColumn("bin", F.least(F.floor(rank * bins), F.lit(bins - 1))).groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    binned = binned.withColumns({"_r": F.sum("r").over(whole), "_c": F.sum("c").over(whole)})
    a, b = (F.when(F.col(w) > 0, F.greatest(ratio(x, w), F.lit(SHARE_FLOOR))) for x, w in (("r", "_r"), ("c", "_c")))
    psi = binned.groupBy("feature").agg(F.sum((b - a) * F.ln(b / a)).alias("psi"))
    sizes = both.groupBy("feature").agg(
        F.sum("r").alias("reference_rows"), F.sum("c").alias("current_rows"), *[F.coalesce(F.sum(F.when(~value, F.col(x))), F.lit(0)).alias(f"_{x}") for x in "rc"]
    )
    medians = {n: quantile(sides[s], 0.5).withColumnRenamed("value", f"{n}_median") for s, n in (("r", "reference"), ("c", "current"))}
    out = sizes.join(psi, "feature", "left")
    for table in medians.values():
        out = out.join(table, "feature", "left")
    return out.select(
        "feature",
        "reference_rows",
        "current_rows",
        rounded(ratio(F.col("_r") * 100.0, "reference_rows"), 4).alias("reference_missing_pct"),
        rounded(ratio(F.col("_c") * 100.0, "current_rows"), 4).alias("current_missing_pct"),
        rounded("reference_median", 4).alias("reference_median"),
        rounded("current_median", 4).alias("current_median"),
        rounded("psi", 6).alias("psi"),
    )
