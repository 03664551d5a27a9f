"""Exact ranks, tiles, running sums and tie-averaged percentiles over a whole table.

A window without a partition key sends every row to one task. Here rows are range-partitioned on
the order instead, each partition is sorted on its own, and only the per-partition totals (one row
per shuffle partition) are accumulated centrally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import materialise, shuffle_width

_BITS = 33
"""monotonically_increasing_id keeps the row position in the low 33 bits, the partition above."""

HOT_SHARE = 1000
"""A value is hot when it holds at least 1/HOT_SHARE of all rows, so at most HOT_SHARE values are."""


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows sorted across partitions, with their partition and their position in it.

    Range boundaries are sampled, so the placement is stored before it is read twice. There are
    as many ranges as shuffle partitions: the bytes of sorted keys compress too well to let
    adaptive execution choose by size.
    """
    spread = (
        df.repartitionByRange(shuffle_width(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return materialise(spread).withColumns(
        {"_part": F.shiftright("_at", _BITS), "_pos": F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))}
    )


def _offsets(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier partitions and of the whole table; one row per partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    shown = []
    for k in sums:
        shown.append(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}"))
        shown.append(F.sum(f"_t_{k}").over(Window.partitionBy()).alias(f"_all_{k}"))
    return totals.select("_part", *shown)


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank", total: str = "rows_total") -> DataFrame:
    """Add the 1-based rank of each row under a total order, and the number of rows."""
    placed = _placed(df, order)
    offsets = _offsets(placed, {"n": F.lit(1)})
    ranked = placed.join(F.broadcast(offsets), "_part")
    return ranked.withColumns(
        {rank: F.col("_before_n") + F.col("_pos") + 1, total: F.col("_all_n")}
    ).drop("_at", "_part", "_pos", "_before_n", "_all_n")


def prefix_sums(
    df: DataFrame, order: list[Column], sums: dict[str, str], totals: dict[str, str] | None = None
) -> DataFrame:
    """Add inclusive running sums along an order; ``sums`` and ``totals`` map output name -> column."""
    placed = _placed(df, order)
    columns = {c: F.col(c) for c in {*sums.values(), *(totals or {}).values()}}
    offsets = _offsets(placed, columns)
    running = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), "_part")
    new = {name: F.col(f"_before_{c}") + F.sum(c).over(running) for name, c in sums.items()}
    new |= {name: F.col(f"_all_{c}") for name, c in (totals or {}).items()}
    return joined.withColumns(new).select(*df.columns, *new)


def grouped_prefix_sums(df: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Inclusive running sums inside each group (``cum_x``) and group totals (``all_x``).

    The table is accumulated once in (group, order) sequence; each group then subtracts what came
    before it. ``by`` must be low-cardinality (models, folds, features): its totals are broadcast.
    """
    run = prefix_sums(df, [F.col(b).asc() for b in by] + order, {f"_c_{x}": x for x in sums})
    start = [F.min(F.col(f"_c_{x}") - F.col(x)).alias(f"_s_{x}") for x in sums]
    totals = [F.sum(x).alias(f"all_{x}") for x in sums]
    if by:
        groups = run.groupBy(*by).agg(*start, *totals)
        joined = run.join(F.broadcast(groups), by)
    else:
        groups = run.groupBy(F.lit(1).alias("_one")).agg(*start, *totals)
        joined = run.withColumn("_one", F.lit(1)).join(F.broadcast(groups), "_one").drop("_one")
    return joined.withColumns({f"cum_{x}": F.col(f"_c_{x}") - F.col(f"_s_{x}") for x in sums}).drop(
        *[f"_c_{x}" for x in sums], *[f"_s_{x}" for x in sums]
    )


def grouped_rank(df: DataFrame, by: list[str], order: list[Column], rank: str, size: str) -> DataFrame:
    """1-based rank inside each low-cardinality group (labels, models, folds), and the group's size."""
    ranked = global_rank(df, [F.col(b).asc() for b in by] + order, "_r", "_n")
    groups = ranked.groupBy(*by).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias(size))
    return (
        ranked.join(F.broadcast(groups), by)
        .withColumn(rank, F.col("_r") - F.col("_first") + 1)
        .drop("_r", "_n", "_first")
    )


def percent_rank(rank: str = "rank", total: str = "rows_total") -> Column:
    """(rank - 1) / (rows - 1), 0 for a single row."""
    return F.coalesce(F.try_divide(F.col(rank) - 1, F.col(total) - 1), F.lit(0.0))


def tile(k: int, rank: str = "rank", total: str = "rows_total") -> Column:
    """SQL NTILE from a rank: the first rows % k tiles hold one row more."""
    r, n = F.col(rank), F.col(total)
    small, extra = F.floor(n / k), n % k
    split = extra * (small + 1)
    return (
        F.when(r <= split, F.floor((r - 1) / (small + 1)) + 1)
        .otherwise(extra + F.floor(F.try_divide(r - 1 - split, small)) + 1)
        .cast("bigint")
    )


def with_value_rank(df: DataFrame) -> DataFrame:
    """Rank customers by value, then id, ascending: adds value_percentile and keeps the rank."""
    ranked = global_rank(df, [F.col("value").asc(), F.col("id").asc()], "value_rank", "customers_total")
    return ranked.withColumn("value_percentile", percent_rank("value_rank", "customers_total"))


def average_rank_percent(df: DataFrame, value: str, out: str, row_key: str = "id") -> DataFrame:
    """Percentile rank x 100 in which equal values share the mean of their ranks.

    Distinct values are counted first, then ranked. A value that a large part of the rows shares
    is attached by broadcast (there are at most HOT_SHARE of those); the other rows join on the
    value. Hot rows are spread over the second join by a salt that matches nothing.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    cumulated = prefix_sums(counts, [F.col(value).asc()], {"_upto": "_n"}, {"_rows": "_n"})
    mean_rank = F.col("_upto") - (F.col("_n") - 1) / 2.0
    dim = cumulated.withColumn("_pct", mean_rank * 100.0 / F.col("_rows"))
    is_hot = F.col("_n") * HOT_SHARE >= F.col("_rows")
    hot = dim.filter(is_hot).select(value, F.col("_pct").alias("_hot"))
    cold = dim.filter(~is_hot).select(value, F.lit(0).alias("_salt"), F.col("_pct").alias("_cold"))
    salted = df.join(F.broadcast(hot), value, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | F.col(value).isNull(), F.pmod(F.hash(row_key), 997) + 1).otherwise(0)
    )
    joined = salted.join(cold, [value, "_salt"], "left")
    return joined.withColumn(out, F.coalesce("_hot", "_cold")).select(*df.columns, out)
