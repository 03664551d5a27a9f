"""Samples without replacement of exact size, the same rows in any partitioning, without sorting the table.

Every row has a 60-bit keyed hash. A histogram of its leading bits tells in which bucket the wanted number is reached: rows of
earlier buckets are all in, and only the rows of that one bucket are ranked.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import materialise

BUCKET_ROWS = 20_000
"""Rows of a bucket, on average; so many are ranked for each stratum."""
_BITS = 60


def sample_key(key: str, seed: int) -> Column:
    """The first 60 bits of the MD5 of seed and key as text."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("bigint")


def exact_sample(df: DataFrame, wanted: int | float, strata: list[str] | None = None, key: str = "id", seed: int = 42) -> DataFrame:
    """``wanted`` rows of each stratum (all, if it has fewer), those with the smallest keyed hashes, ties by the key.

    A ``wanted`` below 1 is a share, rounded up. Null strata are strata of their own. A key that is not unique still gives
    samples of exact size, but which of its rows are in is then not fixed.
    """
    by = F.to_json(F.struct(*[F.col(c) for c in strata])) if strata else F.lit("")
    rows = df.withColumns({"_stratum": by, "_hash": sample_key(key, seed)})
    total = df.count()
    bits = max(0, min(40, ceil(log2(max(total, 1) / BUCKET_ROWS)))) if total > BUCKET_ROWS else 0
    rows = rows.withColumn("_bucket", F.shiftright("_hash", _BITS - bits))
    counts = rows.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_stratum")
    target = F.lit(wanted).cast("bigint") if wanted >= 1 else F.ceil(F.sum("_n").over(whole) * F.lit(float(wanted)) - F.lit(1e-9))
    upto = F.sum("_n").over(whole.orderBy("_bucket"))
    cut = counts.withColumns({"_want": target, "_before": upto - F.col("_n"), "_upto": upto})
    cut = cut.filter("_before < _want").groupBy("_stratum").agg(F.max_by(F.struct("_bucket", "_before", "_want"), "_bucket").alias("_cut"))
    marked = rows.join(materialise(cut), "_stratum")
    inside = marked.filter("_bucket < _cut._bucket")
    place = F.row_number().over(whole.orderBy("_hash", key))
    edge = marked.filter("_bucket = _cut._bucket").withColumn("_place", place).filter("_place <= _cut._want - _cut._before")
    return inside.select(*df.columns).union(edge.select(*df.columns))
