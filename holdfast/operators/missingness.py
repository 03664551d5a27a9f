"""Missing-value profiling: by column, split and label, and the treatment it leads to.

All reports start from one aggregate per (split, label): the number of rows and, per column, the
NULL and zero counts. That result has a handful of rows and is unpivoted for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.features import DATE_COLUMNS, LATEST_VOICE, STRUCTURAL
from holdfast.operators.splitting import DEVELOPMENT, VALIDATION

HIGH_MISSING = 70.0
STABILITY_LIMIT = 5.0
CALENDAR_COLUMNS = ("last_date_of_month_6", "last_date_of_month_7", "last_date_of_month_8")


def predictors(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("id", "label", "split")]


def numeric_predictors(df: DataFrame) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in predictors(df) if kinds[c] != "string"]


def null_counts(df: DataFrame) -> DataFrame:
    """(split, label, feature, rows, missing, zero), one full pass."""
    columns, numeric = predictors(df), set(numeric_predictors(df))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs.append(F.expr(f"count_if({c} IS NULL)").alias(f"m_{c}"))
        zero = f"count_if({c} = 0)" if c in numeric else "0L"
        aggs.append(F.expr(zero).alias(f"z_{c}") if c in numeric else F.first(F.lit(0)).cast("bigint").alias(f"z_{c}"))
    wide = df.groupBy("split", "label").agg(*aggs)
    entries = ", ".join(f"struct('{c}' AS feature, m_{c} AS missing, z_{c} AS zero)" for c in columns)
    return wide.selectExpr("split", "label", "rows", f"inline(array({entries}))")


def missing_band(pct: Column) -> Column:
    return (
        F.when(pct == 0, "0%")
        .when(pct < 10, "0–10%")
        .when(pct < 30, "10–30%")
        .when(pct < 70, "30–70%")
        .otherwise("≥70%")
    )


def _pct(part: Column, whole: Column) -> Column:
    return ratio(part * 100.0, whole)


def _sum_where(cond: Column, column: str) -> Column:
    return F.sum(F.when(cond, F.col(column)).otherwise(0))


def dev() -> Column:
    return F.col("split") == DEVELOPMENT


def val() -> Column:
    return F.col("split") == VALIDATION


def churned() -> Column:
    return F.col("label") == 1


def missingness_profile(counts: DataFrame) -> DataFrame:
    groups = counts.filter(dev()).groupBy("feature").agg(
        F.sum("missing").alias("missing_count"), F.sum("rows").alias("total_rows")
    )
    pct = _pct(F.col("missing_count"), F.col("total_rows"))
    return groups.select(
        "feature",
        "missing_count",
        "total_rows",
        rounded(pct, 4).alias("missing_pct"),
        missing_band(pct).alias("missingness_band"),
    )


def missingness_stability(counts: DataFrame) -> DataFrame:
    """Development against validation; more than 5 points apart needs review."""
    groups = counts.groupBy("feature").agg(
        _pct(_sum_where(dev(), "missing"), _sum_where(dev(), "rows")).alias("d"),
        _pct(_sum_where(val(), "missing"), _sum_where(val(), "rows")).alias("v"),
    )
    gap = F.abs(F.col("d") - F.col("v"))
    return groups.select(
        "feature",
        rounded("d", 4).alias("development_missing_pct"),
        rounded("v", 4).alias("validation_missing_pct"),
        rounded(gap, 4).alias("absolute_difference_pct"),
        F.when(gap > STABILITY_LIMIT, "Review").otherwise("Stable").alias("stability_flag"),
    )


def _by_label(counts: DataFrame) -> DataFrame:
    return counts.filter(dev()).groupBy("feature").agg(
        _pct(_sum_where(~churned(), "missing"), _sum_where(~churned(), "rows")).alias("r"),
        _pct(_sum_where(churned(), "missing"), _sum_where(churned(), "rows")).alias("c"),
        _pct(_sum_where(~churned(), "zero"), _sum_where(~churned(), "rows")).alias("rz"),
        _pct(_sum_where(churned(), "zero"), _sum_where(churned(), "rows")).alias("cz"),
        _pct(F.sum("missing"), F.sum("rows")).alias("m"),
        _pct(F.sum("zero"), F.sum("rows")).alias("z"),
        F.sum("missing").alias("missing_count"),
    )


def missingness_by_label(counts: DataFrame) -> DataFrame:
    gap = F.col("c") - F.col("r")
    return _by_label(counts).select(
        "feature",
        rounded("r", 4).alias("retained_missing_pct"),
        rounded("c", 4).alias("churned_missing_pct"),
        rounded(F.abs(gap), 4).alias("absolute_difference_pct"),
        F.when(gap > 0, "Higher in churned").when(gap < 0, "Higher in retained").otherwise("Equal").alias("direction"),
    )


def value_spread(df: DataFrame) -> DataFrame:
    """Distinct known values, minimum and maximum per numeric column.

    Values are counted per (feature, value) first, so a frequent value is one row after the
    map-side combine.
    """
    columns = numeric_predictors(df)
    entries = ", ".join(f"struct('{c}' AS feature, cast({c} AS double) AS value)" for c in columns)
    long = df.selectExpr(f"inline(array({entries}))").filter("value IS NOT NULL")
    return long.groupBy("feature", "value").count().groupBy("feature").agg(
        F.count(F.lit(1)).alias("unique_non_missing"),
        F.min("value").alias("min_non_missing"),
        F.max("value").alias("max_non_missing"),
    )


def high_missing_profile(counts: DataFrame, spread: DataFrame) -> DataFrame:
    """Columns with at least 70 % missing: what the known values look like, and by label."""
    high = _by_label(counts).filter(F.col("m") >= HIGH_MISSING)
    return high.join(F.broadcast(spread), "feature", "left").select(
        "feature",
        rounded("m", 4).alias("missing_pct"),
        rounded("z", 4).alias("zero_pct"),
        rounded(F.lit(100.0) - F.col("m") - F.col("z"), 4).alias("non_zero_pct"),
        F.coalesce("unique_non_missing", F.lit(0)).alias("unique_non_missing"),
        "min_non_missing",
        "max_non_missing",
        rounded("r", 4).alias("retained_missing_pct"),
        rounded("c", 4).alias("churned_missing_pct"),
        rounded(F.col("c") - F.col("r"), 4).alias("difference_pct"),
    )


def voice_zero_or_missing(counts: DataFrame) -> DataFrame:
    """Latest-period voice columns: missing and zero shares by label."""
    return (
        _by_label(counts)
        .filter(F.col("feature").isin(*LATEST_VOICE))
        .select(
            "feature",
            rounded("r", 4).alias("retained_missing_pct"),
            rounded("c", 4).alias("churned_missing_pct"),
            rounded(F.col("c") - F.col("r"), 4).alias("missing_difference_pct"),
            rounded("rz", 4).alias("retained_zero_pct"),
            rounded("cz", 4).alias("churned_zero_pct"),
        )
    )


def unique_counts(df: DataFrame) -> DataFrame:
    """Distinct values per column, NULL counting as a value."""
    entries = ", ".join(f"struct('{c}' AS feature, cast({c} AS string) AS value)" for c in predictors(df))
    long = df.selectExpr(f"inline(array({entries}))")
    return long.groupBy("feature", "value").count().groupBy("feature").agg(F.count(F.lit(1)).alias("unique_count"))


def constant_check(df: DataFrame) -> DataFrame:
    """``unique_count`` of 1 for columns without variation and 2 for all others, from one aggregate.

    Enough for the treatment rules and free of the (column, value) shuffle of ``unique_counts``.
    """
    columns = predictors(df)
    same = "count({0}) = 0 OR (count({0}) = count(1) AND min({0}) = max({0}))"
    flags = df.agg(*[F.expr(f"if({same.format(c)}, 1L, 2L)").alias(c) for c in columns])
    entries = ", ".join(f"struct('{c}' AS feature, {c} AS unique_count)" for c in columns)
    return flags.selectExpr(f"inline(array({entries}))")


def is_data_service(feature: Column) -> Column:
    return feature.isin(*[f"{m}_{p}" for m in STRUCTURAL for p in (6, 7, 8)])


# Mechanism -> (treatment, missingness indicator, status).
TREATMENTS = {
    "Calendar Metadata": ("Exclude from modeling", "No", "Approved"),
    "Non-informative / Constant": ("Exclude from modeling", "No", "Approved"),
    "Date / Activity (complete)": ("Derive date-based features", "Consider", "Approved"),
    "Date / Activity": (
        "Derive recency/activity features; do not use arbitrary date imputation",
        "Yes if activity state is informative",
        "Approved",
    ),
    "Data-Service / Complete": ("No missing-value treatment", "No", "Approved"),
    "Structural Data-Service Candidate": (
        "Confirm semantics before zero treatment; preserve missingness where informative",
        "Yes if informative",
        "Pending Validation",
    ),
    "Ordinary / Limited Missingness": (
        "Assess necessity; controlled development-set imputation if required",
        "Consider",
        "Pending Validation",
    ),
    "Unknown / Requires Investigation": (
        "Investigate business semantics before transformation",
        "Consider",
        "Pending Validation",
    ),
    "No Missingness": ("No missing-value treatment", "No", "Approved"),
}


def mechanism(feature: Column, missing: Column, pct: Column, unique: Column) -> Column:
    """The first rule that applies decides: calendar, constant, date, data service, amount missing."""
    return (
        F.when(feature.isin(*CALENDAR_COLUMNS), "Calendar Metadata")
        .when(unique <= 1, "Non-informative / Constant")
        .when(feature.isin(*DATE_COLUMNS) & (missing == 0), "Date / Activity (complete)")
        .when(feature.isin(*DATE_COLUMNS), "Date / Activity")
        .when(is_data_service(feature) & (missing == 0), "Data-Service / Complete")
        .when(is_data_service(feature), "Structural Data-Service Candidate")
        .when((pct > 0) & (pct < 10), "Ordinary / Limited Missingness")
        .when(pct >= 10, "Unknown / Requires Investigation")
        .otherwise("No Missingness")
    )


def treatment_map(counts: DataFrame, uniques: DataFrame) -> DataFrame:
    rows = _by_label(counts).join(F.broadcast(uniques), "feature")
    kind = mechanism(F.col("feature"), F.col("missing_count"), F.col("m"), F.col("unique_count"))

    def looked_up(i: int) -> Column:
        pairs = [x for k, v in TREATMENTS.items() for x in (F.lit(k), F.lit(v[i]))]
        return F.create_map(*pairs)[F.col("kind")]

    return rows.withColumn("kind", kind).select(
        "feature",
        "unique_count",
        "missing_count",
        rounded("m", 4).alias("missing_pct"),
        rounded("r", 4).alias("retained_missing_pct"),
        rounded("c", 4).alias("churned_missing_pct"),
        rounded(F.col("c") - F.col("r"), 4).alias("target_missingness_gap_pp"),
        F.regexp_replace("kind", r" \(complete\)$", "").alias("mechanism"),
        looked_up(0).alias("treatment"),
        looked_up(1).alias("missingness_indicator"),
        looked_up(2).alias("status"),
    )


# Name fragments of the feature families, tried in this order.
FAMILIES = (
    ("Customer Tenure", "tenure|^aon$"),
    ("Customer Value", "arpu|revenue|value"),
    ("Recharge Activity", "rech|recharge"),
    ("Voice / Call Behavior", "voice|mou|og_|ic_"),
    ("Data Engagement", "data|3g|2g|vol_"),
    ("Recency", "recency|last_rech"),
    ("Behavioral Trend", "trend|decline|deterioration"),
    ("Temporal Change", "change"),
    ("Recent vs Baseline", "baseline"),
    ("Activity Signal", "inactive|activity"),
    ("Missingness Signal", "missing"),
)
OTHER_FAMILY = "Original / Other"


def feature_family(feature: Column) -> Column:
    name = F.lower(feature)
    out = F.when(name.rlike(FAMILIES[0][1]), FAMILIES[0][0])
    for family, fragments in FAMILIES[1:]:
        out = out.when(name.rlike(fragments), family)
    return out.otherwise(OTHER_FAMILY)


def feature_register(counts: DataFrame, uniques: DataFrame) -> DataFrame:
    """One row per column: family, treatment and status."""
    return treatment_map(counts, uniques).select(
        "feature",
        feature_family(F.col("feature")).alias("feature_family"),
        "mechanism",
        "treatment",
        "status",
        F.when(F.col("treatment") == "Exclude from modeling", "Excluded").otherwise("Candidate").alias("candidacy"),
    )


def date_audit(df: DataFrame, ends: dict[str, object]) -> DataFrame:
    """Conversion loss, negative recency and future dates of the text date columns."""
    aggs = []
    for c, end in ends.items():
        day = f"try_to_date({c}, 'M/d/yyyy')"
        aggs += [
            F.expr(f"count({c})").alias(f"o_{c}"),
            F.expr(f"count({day})").alias(f"v_{c}"),
            F.expr(f"count_if({day} > DATE '{end}')").alias(f"f_{c}"),
        ]
    entries = ", ".join(
        f"struct('{c}' AS feature, o_{c} AS original_non_null, v_{c} AS converted_non_null,"
        f" o_{c} - v_{c} AS conversion_loss, f_{c} AS invalid_negative, f_{c} AS invalid_future_dates)"
        for c in ends
    )
    return df.agg(*aggs).selectExpr(f"inline(array({entries}))").withColumn(
        "status", F.when((F.col("conversion_loss") == 0) & (F.col("invalid_negative") == 0), "PASS").otherwise("REVIEW")
    )
