"""Metric sets that many reports share, and small aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import specs as S
from holdfast.functions import band_rules  # noqa: F401  (registers the bands)
from holdfast.functions.numeric import percent, rounded
from holdfast.operators.quantiles import medians_wide
from holdfast.session import materialise


def mean(measure: str | Column, digits: int = 2) -> Column:
    return rounded(F.avg(measure), digits)


def total(measure: str | Column) -> Column:
    return rounded(F.coalesce(F.sum(measure), F.lit(0.0)))


def with_medians(df: DataFrame, aggregates: list[Column], medians: dict[str, str]) -> DataFrame:
    """One row of aggregates and exact medians; ``medians`` maps output name -> measure.

    The measures are stored once and read twice: Spark's own exact median would keep every distinct
    value of a column in the buffer of one task.
    """
    rows = materialise(df)
    sums = rows.groupBy(F.lit(1).alias("_one")).agg(*aggregates)
    middle = medians_wide(rows, list(medians.values())).select(
        "_one", *[rounded(measure).alias(name) for name, measure in medians.items()]
    )
    return sums.join(F.broadcast(middle), "_one", "left").drop("_one")


def customers() -> Column:
    return F.count(F.lit(1))


def churners() -> Column:
    return F.count_if(F.col("label") == 1)


def churn_rate() -> Column:
    return percent(churners(), customers())


def churn_band(key: str, band: str, where: str | None = None) -> S.Profile:
    return S.Profile(
        {key: band},
        {
            "customers": S.Count(),
            "churned_customers": S.Churners(),
            "churn_rate_pct": S.Rate(),
            "customer_share_pct": S.Share(),
            "churn_contribution_pct": S.Contribution(),
        },
        where=where,
    )


def observed(keys: dict[str, str], averages: dict[str, object] | None = None, **options) -> S.Profile:
    """Count, share, optional averages and the observed churn rate."""
    show = {"customers": S.Count(), "customer_share_pct": S.Share(), **(averages or {})}
    return S.Profile(keys, {**show, "observed_churn_rate_pct": S.Rate()}, **options)


def with_churners(
    keys: dict[str, str], extra: dict[str, object] | None = None, contribution: bool = False, **options
) -> S.Profile:
    """Count, share, optional metrics, churners, observed rate and optionally the churn contribution."""
    show = {"customers": S.Count(), "customer_share_pct": S.Share(), **(extra or {}), "churners": S.Churners()}
    show["observed_churn_rate_pct"] = S.Rate()
    if contribution:
        show["churn_contribution_pct"] = S.Contribution()
    return S.Profile(keys, show, **options)
