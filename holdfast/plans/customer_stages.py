"""From a customer panel to scores, operating points, risk, exposure, retention and monitoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import band_rules  # noqa: F401  (registers the bands)
from holdfast.functions.bands import band
from holdfast.functions.measures import with_measures
from holdfast.functions.numeric import rounded
from holdfast.operators import (
    categories,
    exposure,
    features,
    metrics,
    monitoring,
    quantiles,
    ranking,
    retention,
    risk,
    sampling,
    scoring,
    splitting,
    summaries,
    thresholds,
)
from holdfast.operators.scoring import PRIMARY_THRESHOLD, scored
from holdfast.plans import trained
from holdfast import PERIODS
from holdfast.session import materialise
from holdfast.sources.published import stored_stage

FIXTURE_PRECISION = 0.40
"""Eligibility bound for the fixtures, whose churners are spread evenly over the scores."""
DRIFT_FEATURES = ["aon", "arpu_8", "total_rech_amt_8", "total_rech_num_8", "total_og_mou_8", "vol_2g_mb_8"]
NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")


def of_split(scores: DataFrame, name: str) -> DataFrame:
    return splitting.with_split(scores).filter(f"split = '{name}'")


def confirmation(scores: DataFrame) -> DataFrame:
    """Operating points chosen on development customers, confirmed on validation customers."""
    dev = materialise(of_split(scores, splitting.DEVELOPMENT))
    primary = thresholds.primary_threshold(thresholds.threshold_sweep(dev), precision=FIXTURE_PRECISION)
    points = primary.select(F.lit("Primary_threshold").alias("operating_point"), "threshold").unionByName(
        thresholds.capacity_threshold(dev).select(F.lit("Capacity_10_percent_threshold").alias("operating_point"), "threshold")
    )
    return thresholds.confirm_on(of_split(scores, splitting.VALIDATION), points)


def drift(panel: DataFrame) -> DataFrame:
    rows = splitting.with_split(panel.select("id", "label", *DRIFT_FEATURES))
    return monitoring.feature_drift(
        rows, DRIFT_FEATURES, "split", splitting.DEVELOPMENT, splitting.VALIDATION
    )


def drift_of_all(panel: DataFrame) -> DataFrame:
    """Drift of every numeric column of the panel and of every numeric feature built from it."""
    rows = features.build_features(panel)
    names = [n for n, t in rows.dtypes if t.startswith(NUMERIC) and n not in ("id", "label")]
    # stored: planned once, not again for each statistic
    dealt = materialise(splitting.join_split(rows.select("id", "label", *names)))
    return monitoring.feature_drift(dealt, names, "split", splitting.DEVELOPMENT, splitting.VALIDATION)


def category_columns(panel: DataFrame) -> list[str]:
    """Flags and texts of the panel."""
    flags = [f"{m}_{p}" for m in ("fb_user", "night_pck_user") for p in PERIODS]
    return flags + [n for n, t in panel.dtypes if t == "string"]


def category_counts(panel: DataFrame) -> DataFrame:
    columns = category_columns(panel)
    rows = splitting.join_split(panel.select("id", "label", *columns))
    return materialise(categories.category_counts(rows, columns, "split", splitting.DEVELOPMENT, splitting.VALIDATION))


COMPARISONS = {"7 against 6": ((6, 6), (7, 7)), "8 against 7": ((7, 7), (8, 8)), "8 against 6 to 7": ((6, 7), (8, 8))}


def period_columns(panel: DataFrame, period: int) -> dict[str, str]:
    """Feature name -> column of all numbers that exist in each period."""
    numeric = [n for n, t in panel.dtypes if t.startswith(NUMERIC) and n.endswith(f"_{period}")]
    return {n.removesuffix(f"_{period}"): n for n in numeric}


def period_summary(panel: DataFrame, period: int) -> DataFrame:
    """Summary of one period, made once from that period's columns and stored."""
    columns = period_columns(panel, period)
    own = panel.select("id", *columns.values())
    return stored_stage(own, f"summary-{period}", (summaries.GROWTH, period), lambda rows: summaries.summary(rows, columns, period))


def drift_over_time(panel: DataFrame) -> DataFrame:
    """Each period against earlier ones, from their stored summaries."""
    stored = period_summary(panel, PERIODS[0])
    for period in PERIODS[1:]:
        stored = stored.unionByName(period_summary(panel, period))
    out = None
    for name, (reference, current) in COMPARISONS.items():
        one = summaries.compared(stored, reference, current).select(F.lit(name).alias("comparison"), "*")
        out = one if out is None else out.unionByName(one)
    return out


RAW_COLUMNS = ("aon", "arpu_8", "total_rech_num_8", "date_of_last_rech_8")


def scanned(panel: DataFrame) -> DataFrame:
    """Lines, customers, set-aside rows and lost conversions of a CSV file of the panel in which some lines are spoilt.

    Spoilt by the id: every 17th has words for a number, every 23rd lacks its last values, every 29th has an unreadable outcome.
    """
    from uuid import uuid4

    from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

    from holdfast.session import ensure_checkpoint_dir
    from holdfast.sources.contract import SOURCE_LABEL, scan_customers

    spark = panel.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/raw-{uuid4().hex}"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.when(F.col("id") % 17 == 0, F.lit("n/a")).otherwise(text("aon"))
    outcome = F.when(F.col("id") % 29 == 0, F.lit("yes")).otherwise(text("label"))
    whole = F.concat_ws(",", text("id"), outcome, number, *[text(c) for c in RAW_COLUMNS[1:]])
    line = F.when(F.col("id") % 23 == 0, F.concat_ws(",", text("id"), outcome)).otherwise(whole)
    head = ",".join(("id", SOURCE_LABEL, *RAW_COLUMNS))
    # a header line for each file, as other writers make it
    panel.select(line.alias(head)).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("delimiter", "\u0001").csv(path)
    schema = StructType().add("id", LongType()).add(SOURCE_LABEL, IntegerType()).add("aon", IntegerType())
    schema = schema.add("arpu_8", DoubleType()).add("total_rech_num_8", LongType()).add("date_of_last_rech_8", StringType())
    good, aside, lost = scan_customers(spark, path, schema)
    figures = good.agg(F.lit("customers").alias("item"), F.count(F.lit(1)).alias("n"))
    figures = figures.union(aside.groupBy(F.concat(F.lit("set aside: "), "reason")).agg(F.count(F.lit(1))))
    return figures.union(lost.select(F.concat(F.lit("lost conversions: "), "column"), "lost_conversions"))


def batch_scores(panel: DataFrame) -> DataFrame:
    """All customers scored; missing measures take the medians of development customers."""
    columns = list(scoring.Scorecard().weights)
    rows = splitting.join_split(panel.select("id", "label", *columns))
    medians = materialise(quantiles.medians_wide(rows.filter(F.col("split") == splitting.DEVELOPMENT), columns))
    return scoring.batch_score(panel, medians=medians)


def grid(scores: DataFrame) -> DataFrame:
    return materialise(retention.sensitivity_rows(scores))


def value_ranks(panel: DataFrame) -> DataFrame:
    """Rank, percent rank and quartile of every customer by value."""
    rows = ranking.with_value_rank(scored(panel).select("id", "value"))
    return rows.select(
        "id",
        "value_rank",
        rounded("value_percentile", 6).alias("value_percentile"),
        ranking.tile(4, "value_rank", "customers_total").alias("value_quartile"),
    )


def value_percentiles(panel: DataFrame) -> DataFrame:
    """Tie-averaged percentile of every customer by value; the many zero values share one rank."""
    rows = materialise(scored(panel).select("id", "value"))
    ranked = ranking.average_rank_percent(rows, "value", "percentile")
    return ranked.select("id", rounded("percentile", 6).alias("percentile"))


def banded(panel: DataFrame) -> DataFrame:
    """A left-closed ladder and a three-period course per customer."""
    return with_measures(panel).select(
        "id",
        band("tenure_profile").alias("tenure_band"),
        band("voice_consistency").alias("voice_course"),
        band("arpu_change_band").alias("arpu_change"),
    )


ON_SCORES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "m01_confusion_metrics": lambda s: metrics.confusion(s),
    "m02_rank_metrics": lambda s: metrics.rank_metrics(s),
    "m03_topk_capture_lift": lambda s: metrics.top_share_metrics(s),
    "m04_curves": lambda s: metrics.curves(s),
    "c03_ece": lambda s: metrics.calibration_error(s),
    "c04_reliability_curve": lambda s: metrics.reliability(s),
    "t01_threshold_sweep": lambda s: thresholds.threshold_sweep(s),
    "t02_cost_scenarios": lambda s: thresholds.cost_scenarios(s),
    "t03_capacity": lambda s: thresholds.capacity_table(s),
    "t04_primary_threshold": lambda s: thresholds.primary_threshold(
        thresholds.threshold_sweep(s), precision=FIXTURE_PRECISION
    ),
    "t05_capacity_threshold": lambda s: thresholds.capacity_threshold(s),
    "t06_validation_confirm": confirmation,
    "t07_risk_bands": lambda s: thresholds.band_summary(s),
    "r01_risk_level": lambda s: s.select(
        "id", "score", scoring.risk_level(F.col("score")).alias("risk_level")
    ),
    "r02_risk_table": lambda s: risk.risk_table(s),
    "r03_risk_distribution": lambda s: risk.risk_distribution(s),
    "r04_risk_gate": lambda s: risk.risk_gate(risk.risk_table(s)),
    "r05_top_risk": lambda s: risk.top_risk(s),
    "r07_intervention_tiers": lambda s: risk.intervention_tiers(s),
    "v01_value_table": lambda s: exposure.shown_value_table(s),
    "v02_value_summary": lambda s: exposure.value_summary(s),
    "v03_exposure_by_risk": lambda s: exposure.exposure_by_risk(s),
    "v04_exposure_by_tier": lambda s: exposure.exposure_by_tier(s),
    "v05_risk_value_matrix": lambda s: exposure.risk_value_matrix(s),
    "v06_concentration": lambda s: exposure.concentration(s),
    "v07_top_exposure": lambda s: exposure.top_exposure(s),
    "v08_value_gate": lambda s: exposure.value_gate(exposure.value_table(s)),
    "v09_customer_value_lookup": lambda s: exposure.record_checks(s),
    "e01_scenario_economics": lambda s: retention.scenario_economics(s),
    "e01_scenario_economics_by_risk": lambda s: retention.scenario_economics(s, by_risk=True),
    "e02_targeting_cohorts": lambda s: retention.targeting_cohorts(s),
    "e03_cohort_overlap": lambda s: retention.cohort_overlap(s),
    "e04_cohort_assignment": lambda s: retention.cohort_assignment(s),
    "e04_cohort_counts": lambda s: retention.cohort_counts(s),
    "e05_cohort_economics": lambda s: retention.cohort_economics(s),
    "e06_sensitivity_grid": lambda s: retention.sensitivity_grid(s),
    "e07_monotonicity_checks": lambda s: retention.monotonicity(grid(s)),
    "e08_break_even_summary": lambda s: retention.break_even_summary(grid(s)),
    "e09_robustness_summary": lambda s: retention.robustness_summary(grid(s)),
    "e10_sensitivity_summary": lambda s: retention.sensitivity_summary(grid(s)),
    "e12_cohort_gate": lambda s: retention.cohort_gate(s),
    "e12_economics_gate": lambda s: retention.economics_gate(retention.cohort_economics(s)),
    "e12_sensitivity_gate": lambda s: retention.sensitivity_gate(grid(s)),
    "d02_score_monitor": lambda s: monitoring.score_monitor(splitting.with_split(s), "split"),
}
"""Reports of (id, label, score, arpu_8, value)."""

STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "g01_global_rank": value_ranks,
    "g02_avg_rank_pct": value_percentiles,
    "g03_band": banded,
    "g04_exact_sample": lambda p: sampling.exact_sample(p.select("id", "label"), 100, ["label"]),
    "g04_exact_sample_share": lambda p: sampling.exact_sample(p.select("id", "label"), 0.1),
    "f02_stratified_split": lambda p: splitting.split_summary(p),
    "m08_stratified_kfold": lambda p: splitting.with_fold(p.select("id", "label")),
    "r06_batch_score": batch_scores,
    "d01_drift_monitor": drift,
    "d01_drift_monitor_all": drift_of_all,
    "d01_category_drift": lambda p: categories.category_drift(category_counts(p)),
    "d01_category_summary": lambda p: categories.category_summary(category_counts(p)),
    "d01_drift_over_time": drift_over_time,
    "f01_csv_scan": scanned,
    "r06_batch_score_trained": trained.batch_scores,
}
# on the transparent card, which SQL can repeat, and on out-of-fold and validation scores of the trained model
STAGES |= {name: (lambda p, report=report: report(scored(p))) for name, report in ON_SCORES.items()}
STAGES |= {f"{name}_trained": trained.on_trained(report) for name, report in ON_SCORES.items()}
