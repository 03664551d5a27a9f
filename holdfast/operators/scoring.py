"""Scoring of customers: a transparent scorecard, sigmoid calibration and risk levels.

The scorecard is a logistic formula over panel measures. It gives every downstream report
(thresholds, risk, exposure, retention) a probability that does not depend on a training run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import rounded

LOGIT_CLIP = 1e-7
"""Probabilities are clipped to [LOGIT_CLIP, 1 - LOGIT_CLIP] before a logit, everywhere."""
PRIMARY_THRESHOLD = 0.1
VERY_HIGH_THRESHOLD = 0.5
LEVELS = ("Below Primary Threshold", "High", "Very High")


@dataclass(frozen=True)
class Scorecard:
    intercept: float = 1.1
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "total_rech_num_8": -0.55,
            "total_rech_num_7": -0.35,
            "arpu_8": -0.0015,
            "total_og_mou_8": -0.002,
            "aon": -0.0003,
        }
    )

    def linear(self) -> str:
        terms = [f"{self.intercept}D"] + [f"({w}D) * coalesce({c}, 0)" for c, w in self.weights.items()]
        return " + ".join(terms)


@dataclass(frozen=True)
class Sigmoid:
    """Platt calibration: probability = 1 / (1 + exp(-(slope * logit(raw) + intercept)))."""

    slope: float = 0.9
    intercept: float = -0.1

    def apply(self, raw: Column) -> Column:
        return logistic(F.lit(self.slope) * logit(raw) + F.lit(self.intercept))


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0 - LOGIT_CLIP)), F.lit(LOGIT_CLIP))


def logit(p: Column) -> Column:
    safe = clipped(p)
    return F.ln(safe / (F.lit(1.0) - safe))


def with_score(df: DataFrame, card: Scorecard = Scorecard(), out: str = "score") -> DataFrame:
    return df.withColumn(out, rounded(logistic(F.expr(card.linear())), 6))


def scored(panel: DataFrame, *extra: str, card: Scorecard = Scorecard()) -> DataFrame:
    """(id, label, score, arpu_8, value, extra…) for every customer of a panel."""
    rows = with_score(panel, card).withColumn("value", F.greatest("arpu_8", F.lit(0.0)))
    return rows.select("id", "label", "score", "arpu_8", "value", *extra)


def risk_level(p: Column, primary: float = PRIMARY_THRESHOLD) -> Column:
    return F.when(p >= VERY_HIGH_THRESHOLD, LEVELS[2]).when(p >= primary, LEVELS[1]).otherwise(LEVELS[0])


class MissingFeatures(ValueError):
    """The table to score lacks columns the scorecard needs."""


def batch_score(
    df: DataFrame,
    card: Scorecard = Scorecard(),
    sigmoid: Sigmoid = Sigmoid(),
    primary: float = PRIMARY_THRESHOLD,
    medians: DataFrame | None = None,
) -> DataFrame:
    """Score any number of customers: check the columns, impute, score, calibrate, assign a level.

    ``medians`` is a one-row table of fill values (for instance the stored development medians);
    without it a missing measure counts as zero.
    """
    absent = [c for c in card.weights if c not in df.columns]
    if absent:
        raise MissingFeatures(", ".join(absent))
    rows = df
    if medians is not None:
        named = medians.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_m_{c}") for c in card.weights])
        rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(named), "_one")
        rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in card.weights})
    rows = with_score(rows, card, "raw_probability")
    calibrated = rounded(sigmoid.apply(F.col("raw_probability")), 6)
    return rows.withColumn("calibrated_probability", calibrated).select(
        "id",
        "raw_probability",
        "calibrated_probability",
        risk_level(F.col("calibrated_probability"), primary).alias("risk_level"),
        (F.col("calibrated_probability") >= primary).alias("above_primary_threshold"),
    )
