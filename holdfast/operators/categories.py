"""Drift of categories: frequent values of two populations, exactly counted; new and vanished ones; change of shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.monitoring import SHARE_FLOOR
from holdfast.session import materialise

LEAST_PCT = 1
"""Values below this percentage of the rows of both populations are counted together."""
SLOTS = 16_384
"""Slots of a hash profile: so many counts at most for each feature, population and profile."""
OTHER, MISSING = "(other)", "(missing)"


def long_categories(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, category): every column as text, null as a category of its own."""
    entries = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category")) for c in columns]
    return df.select(*keys, F.inline(F.array(*entries)))


def frequent(long: DataFrame, population: str, sizes: DataFrame, least_pct: int = LEAST_PCT, slots: int = SLOTS) -> DataFrame:
    """(feature, category) of every value that holds ``least_pct`` of a population's rows; no other value, none left out.

    Two profiles count the rows by two hashes of the value, which bounds them whatever the number of values, and profiles of parts can be
    added up. A frequent value is in a frequent slot of both, so that only values there are counted one by one. There are
    at most 100 / least_pct of these for each feature and population.
    """
    enough = F.col("n") * 100 >= F.col("_rows") * least_pct
    keyed = long.withColumns({f"_s{i}": F.pmod(F.xxhash64(F.lit(i), "category"), F.lit(slots)) for i in (1, 2)})
    some = keyed
    for slot in ("_s1", "_s2"):
        profile = keyed.groupBy("feature", population, slot).agg(F.count(F.lit(1)).alias("n"))
        heavy = profile.join(F.broadcast(sizes), population).filter(enough).select("feature", population, slot)
        some = some.join(F.broadcast(heavy), ["feature", population, slot], "left_semi")
    exact = some.groupBy("feature", population, "category").agg(F.count(F.lit(1)).alias("n"))
    return exact.join(F.broadcast(sizes), population).filter(enough).select("feature", "category").distinct()


def category_counts(df: DataFrame, columns: list[str], population: str, reference: str, current: str, least_pct: int = LEAST_PCT) -> DataFrame:
    """(feature, category, reference_count, current_count) of frequent values, and of all others together."""
    rows = materialise(df.filter(F.col(population).isin(reference, current)).select(population, *columns))
    sizes = materialise(rows.groupBy(population).agg(F.count(F.lit(1)).alias("_rows")))
    long = long_categories(rows, columns, [population])
    known = frequent(long, population, sizes, least_pct).withColumn("_known", F.lit(True))
    named = F.when(F.col("_known"), F.col("category")).otherwise(OTHER).alias("category")
    marked = long.join(F.broadcast(known), ["feature", "category"], "left").select("feature", population, named)
    is_ref = F.col(population) == reference
    return marked.groupBy("feature", "category").agg(F.count_if(is_ref).alias("reference_count"), F.count_if(~is_ref).alias("current_count"))


def _shares(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("feature").agg(F.sum("reference_count").alias("_r"), F.sum("current_count").alias("_c"))
    return counts.join(F.broadcast(totals), "feature")


def category_drift(counts: DataFrame) -> DataFrame:
    """Share of every category in both populations, its change in percentage points, and whether it is new or has vanished."""
    r, c = (ratio(F.col(f"{side}_count") * 100.0, whole) for side, whole in (("reference", "_r"), ("current", "_c")))
    status = F.when(F.col("reference_count") == 0, "New").when(F.col("current_count") == 0, "Vanished").otherwise("Present")
    return _shares(counts).select(
        "feature",
        "category",
        "reference_count",
        "current_count",
        rounded(r, 4).alias("reference_share_pct"),
        rounded(c, 4).alias("current_share_pct"),
        rounded(c - r, 4).alias("share_change"),
        status.alias("status"),
    )


def category_summary(counts: DataFrame) -> DataFrame:
    """Per feature: categories, new and vanished ones, largest change of a share, and the stability index over categories."""

    def share(part: str, whole: str) -> Column:
        return F.greatest(ratio(part, whole), F.lit(SHARE_FLOOR))

    a, b = share("reference_count", "_r"), share("current_count", "_c")
    change = ratio(F.col("current_count") * 100.0, "_c") - ratio(F.col("reference_count") * 100.0, "_r")
    return _shares(counts).groupBy("feature").agg(
        F.count(F.lit(1)).alias("categories"),
        F.count_if(F.col("reference_count") == 0).alias("new_categories"),
        F.count_if(F.col("current_count") == 0).alias("vanished_categories"),
        rounded(F.max(F.abs(change)), 4).alias("largest_share_change"),
        rounded(F.sum((b - a) * F.ln(b / a)), 6).alias("psi"),
    )
