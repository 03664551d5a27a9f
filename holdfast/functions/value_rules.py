"""Bands of the exposure, segmentation and priority reports.

Rules that use the value rank refer to columns the ranked profile has already added:
``value_percentile`` and the bands listed in the spec's ``before_rank``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions.bands import CONDITIONS, LADDERS, RULES, first_match, rule
from holdfast.functions.numeric import flag, sum_columns
from holdfast.functions.periods import falling, fell, is_null, last_two, some, steps, vector
from holdfast.functions.service_rules import CORE
from holdfast.specs import Ladder

C = F.col

HIGH_VALUE_PERCENTILE = 0.75
TENURE = ((365, "Under 1 Year"), (730, "1–2 Years"), (1095, "2–3 Years"), (1825, "3–5 Years"))
VALUE = ((100, "Low"), (250, "Medium"), (500, "High"))

LADDERS.update(
    exposure_value=Ladder("arpu_8", VALUE, "Very High", negative="Negative", zero="Zero"),
    segment_value=Ladder(
        "arpu_8", VALUE, "Very High", missing="Value Unavailable", negative="Negative", zero="Zero"
    ),
    exposure_tenure=Ladder("aon", TENURE, "5+ Years"),
    segment_tenure=Ladder("aon", TENURE, "5+ Years", missing="Tenure Unavailable"),
    segment_data=Ladder(
        "data_8",
        ((100, "Low Data Engagement"), (500, "Moderate Data Engagement")),
        "High Data Engagement",
        missing="Data Usage Unavailable",
        zero="No Data Engagement",
    ),
)


@rule
def value_group() -> Column:
    high = C("value_percentile") >= HIGH_VALUE_PERCENTILE
    return F.when(high, "High Value").otherwise("Other Value")


CONDITIONS.update(
    churned=lambda: C("label") == 1,
    high_value=lambda: C("value_percentile") >= HIGH_VALUE_PERCENTILE,
)


@rule
def recharge_status() -> Column:
    before, now = last_two("total_rech_amt")
    return first_match(
        (before.isNull() | now.isNull(), "Recharge Trend Unavailable"),
        (now < before, "Declining Recharge"),
        otherwise="Stable / Increasing",
    )


def _voice_levels(unknown: str, kind: str) -> Column:
    og, ic = C("total_og_mou_8"), C("total_ic_mou_8")
    return first_match(
        (og.isNull() | ic.isNull(), unknown),
        ((og < 10) & (ic < 10), f"Very Low {kind}"),
        ((og < 50) & (ic < 50), f"Low {kind}"),
        otherwise=f"Active {kind}",
    )


RULES.update(
    exposure_voice=lambda: _voice_levels("Usage Unavailable", "Voice Engagement"),
    segment_voice=lambda: _voice_levels("Usage Unavailable", "Engagement"),
    segment_engagement=lambda: _voice_levels("Engagement Unavailable", "Engagement"),
)


@rule
def decline_status() -> Column:
    (arpu7, arpu8), (amt7, amt8) = last_two("arpu"), last_two("total_rech_amt")
    return first_match(
        (some([arpu7, arpu8, amt7, amt8], is_null), "Incomplete Trend"),
        (fell("arpu") & fell("total_rech_amt"), "ARPU + Recharge Decline"),
        (fell("arpu"), "ARPU Decline"),
        (fell("total_rech_amt"), "Recharge Decline"),
        otherwise="Stable / Improving",
    )


@rule
def segment_recharge() -> Column:
    amount, n = C("total_rech_amt_8"), C("total_rech_num_8")
    return first_match(
        (amount.isNull() | n.isNull(), "Recharge Unavailable"),
        ((amount == 0) & (n == 0), "No Recharge"),
        ((amount < 100) | (n <= 2), "Low Recharge"),
        ((amount < 300) | (n <= 5), "Moderate Recharge"),
        otherwise="High Recharge",
    )


@rule
def executive_segment() -> Column:
    high = C("value_percentile") >= HIGH_VALUE_PERCENTILE
    quiet = C("engagement_group").isin("Very Low Engagement", "Low Engagement")
    active = C("engagement_group") == "Active Engagement"
    thin = C("recharge_group").isin("No Recharge", "Low Recharge")
    solid = C("recharge_group").isin("Moderate Recharge", "High Recharge")
    return first_match(
        (high & quiet, "High Value / Low Engagement"),
        (high & thin, "High Value / Low Recharge"),
        (high & active & solid, "High Value / Active"),
        (~high & quiet, "Other Value / Low Engagement"),
        (~high & thin, "Other Value / Low Recharge"),
        otherwise="Other / Mixed",
    )


@rule
def low_engagement() -> Column:
    og, ic = C("total_og_mou_8"), C("total_ic_mou_8")
    return F.coalesce((og < 50) & (ic < 50) & og.isNotNull() & ic.isNotNull(), F.lit(False))


@rule
def thin_recharge() -> Column:
    amount, n = C("total_rech_amt_8"), C("total_rech_num_8")
    return F.coalesce(((amount < 100) | (n <= 2)) & amount.isNotNull() & n.isNotNull(), F.lit(False))


@rule
def priority_segment() -> Column:
    high = C("value_percentile") >= HIGH_VALUE_PERCENTILE
    quiet, thin = C("low_engagement"), C("thin_recharge")
    cases = []
    for hit, name in ((high, "High Value"), (~high, "Other Value")):
        cases += [
            (hit & quiet & thin, f"{name} / Low Engagement + Low Recharge"),
            (hit & quiet, f"{name} / Low Engagement"),
            (hit & thin, f"{name} / Low Recharge"),
        ]
    cases.append((high, "High Value / Active"))
    return first_match(*cases, otherwise="Other / Active")


def _trend(measures: tuple[str, ...]) -> Column:
    """Incomplete, consistent decline, recent decline, stable or improving, mixed."""
    parts = [c for m in measures for c in vector(m)]
    recent = persistent = steady = F.lit(True)
    for m in measures:
        before, now = last_two(m)
        recent = recent & (now < before)
        persistent = persistent & steps(m, falling)
        steady = steady & (now >= before)
    if len(measures) == 1:
        steady = steps(measures[0], lambda a, b: a <= b)
    return first_match(
        (some(parts, is_null), "Incomplete Trend"),
        (persistent, "Consistent Decline"),
        (recent, "Recent Decline"),
        (steady, "Stable / Improving"),
        otherwise="Mixed Trend",
    )


RULES.update(
    arpu_trend=lambda: _trend(("arpu",)),
    recharge_trend=lambda: _trend(("total_rech_amt",)),
    engagement_trend=lambda: _trend(("total_og_mou", "total_ic_mou")),
)


@rule
def decline_signals() -> Column:
    """How many of the four core measures fell in the last period."""
    return sum_columns([flag(fell(m)) for m in CORE])


@rule
def deterioration_group() -> Column:
    n = C("decline_signals")
    return first_match(
        (n >= 2, "Multiple Deterioration Signals"),
        (n == 1, "Single Deterioration Signal"),
        otherwise="Stable / No Detected Decline",
    )


@rule
def priority_cohort() -> Column:
    high, n = C("value_percentile") >= HIGH_VALUE_PERCENTILE, C("decline_signals")
    return first_match(
        (high & (n >= 2), "Priority Cohort"),
        (high & (n == 1), "Elevated Cohort"),
        (~high & (n >= 2), "Monitoring Cohort"),
        otherwise="Lower Priority",
    )


QUARTILES = ("Q1 — Lowest Value", "Q2 — Lower-Mid Value", "Q3 — Upper-Mid Value", "Q4 — Highest Value")


@rule
def value_quartile() -> Column:
    from holdfast.operators.ranking import tile

    return F.element_at(F.array(*[F.lit(q) for q in QUARTILES]), tile(4, "value_rank", "customers_total").cast("int"))
