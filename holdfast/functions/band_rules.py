"""Bands and conditions of the usage, recharge and service reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions.bands import CONDITIONS, LADDERS, RULES, first_match, rule, where
from holdfast.functions.numeric import either_total
from holdfast.functions.periods import every, falling, is_null, is_zero, last_two, rising, steps, vector
from holdfast.specs import Ladder

C = F.col

# Labels and edges of single-measure bands.
TENURE = ((365, "Under 1 year"), (730, "1-2 years"), (1095, "2-3 years"), (1825, "3-5 years"))
LADDERS.update(
    tenure_overview=Ladder(
        "aon", ((365, "<1 year"), (730, "1–2 years"), (1095, "2–3 years"), (1825, "3–5 years")), "5+ years"
    ),
    arpu_overview=Ladder(
        "arpu_8",
        ((100, "< ₹100"), (200, "₹100–₹199"), (300, "₹200–₹299"), (500, "₹300–₹499")),
        "₹500+",
        missing="ARPU missing",
    ),
    outgoing_overview=Ladder(
        "total_og_mou_8",
        ((50, "<50 minutes"), (100, "50–99 minutes"), (250, "100–249 minutes"), (500, "250–499 minutes")),
        "500+ minutes",
        missing="Usage missing",
        zero="Zero usage",
    ),
    incoming_overview=Ladder(
        "total_ic_mou_8",
        ((50, "<50 minutes"), (100, "50–99 minutes"), (250, "100–249 minutes"), (500, "250–499 minutes")),
        "500+ minutes",
        missing="Usage missing",
        zero="Zero usage",
    ),
    recharge_overview=Ladder(
        "total_rech_amt_8",
        ((100, "< ₹100"), (250, "₹100–₹249"), (500, "₹250–₹499"), (1000, "₹500–₹999")),
        "₹1000+",
        missing="Recharge amount missing",
        zero="₹0",
    ),
    frequency_overview=Ladder(
        "total_rech_num_8",
        ((2, "1–2 recharges"), (5, "3–5 recharges"), (10, "6–10 recharges")),
        "11+ recharges",
        missing="Recharge frequency missing",
        zero="0 recharges",
        closed="right",
    ),
    data_status=Ladder(
        "total_rech_data_8",
        (),
        "Data recharge present",
        missing="Data recharge information missing",
        zero="No data recharge",
    ),
    data_volume_overview=Ladder(
        "data_8",
        ((100, "<100 MB"), (500, "100–499 MB"), (1000, "500–999 MB")),
        "1000+ MB",
        missing="Data usage missing",
        zero="Zero data usage",
    ),
    voice_overview=Ladder(
        "voice_8",
        ((100, "<100 minutes"), (500, "100–499 minutes"), (1000, "500–999 minutes")),
        "1000+ minutes",
        missing="Voice usage missing",
        zero="No voice usage",
    ),
    arpu_group=Ladder("arpu_8", ((300, "Lower ARPU"),), "Higher ARPU", missing="ARPU missing"),
    voice_presence=Ladder(
        "voice_8", (), "Voice usage present", missing="Voice usage missing", zero="No voice usage"
    ),
    tenure_profile=Ladder("aon", TENURE, "5+ years"),
    arpu_profile=Ladder(
        "arpu_8",
        ((100, "Under 100"), (200, "100-199"), (300, "200-299"), (500, "300-499")),
        "500+",
        missing="ARPU missing",
    ),
    recharge_profile=Ladder(
        "total_rech_amt_8",
        ((100, "Under 100"), (250, "100-249"), (500, "250-499"), (1000, "500-999")),
        "1000+",
        missing="Recharge value missing",
        zero="Zero recharge",
    ),
    frequency_profile=Ladder(
        "total_rech_num_8",
        ((1, "1 recharge"), (3, "2-3 recharges"), (5, "4-5 recharges")),
        "6+ recharges",
        missing="Recharge frequency missing",
        zero="Zero recharge",
        closed="right",
    ),
    value_profile=Ladder(
        "arpu_8", ((200, "Lower value"), (500, "Mid value")), "Higher value", missing="ARPU missing"
    ),
    recharge_behavior=Ladder(
        "total_rech_num_8",
        ((1, "Low recharge frequency"), (3, "Moderate recharge frequency")),
        "High recharge frequency",
        missing="Recharge frequency missing",
        closed="right",
    ),
    recharge_recency=Ladder(
        "days_since_recharge_8",
        ((2, "0-2 days"), (5, "3-5 days"), (10, "6-10 days")),
        "11+ days",
        missing="Recharge date missing",
        closed="right",
    ),
    high_arpu_group=Ladder(
        "arpu_8", ((500, "Other customers"),), "Higher-value customers", missing="ARPU missing"
    ),
    outgoing_level=Ladder(
        "total_og_mou_8",
        ((50, "Very low"), (200, "Low"), (500, "Moderate")),
        "High",
        missing="Outgoing usage missing",
        zero="Zero outgoing usage",
    ),
    incoming_level=Ladder(
        "total_ic_mou_8",
        ((25, "Very low"), (100, "Low"), (250, "Moderate")),
        "High",
        missing="Incoming usage missing",
        zero="Zero incoming usage",
    ),
    voice_cell=Ladder(
        "voice_8",
        ((400, "Moderate voice"),),
        "High voice",
        missing="Voice information missing",
        zero="Low voice",
    ),
    data_cell=Ladder(
        "data_8", ((100, "Moderate data"),), "High data", missing="Data information missing", zero="Low data"
    ),
    outgoing_signal=Ladder(
        "total_og_mou_8", ((100, "Low"), (400, "Moderate")), "High", missing="Missing", zero="Zero"
    ),
    incoming_signal=Ladder(
        "total_ic_mou_8", ((50, "Low"), (200, "Moderate")), "High", missing="Missing", zero="Zero"
    ),
    data_signal=Ladder("data_8", ((100, "Low"), (500, "Moderate")), "High", missing="Missing", zero="Zero"),
    revenue_arpu=Ladder(
        "arpu_8",
        ((200, "Lower value"), (500, "Mid value")),
        "Higher value",
        negative="Negative ARPU",
        zero="Zero ARPU",
    ),
    revenue_recharge=Ladder(
        "total_rech_amt_8",
        ((100, "Low recharge"), (300, "Moderate recharge"), (500, "High recharge")),
        "Very high recharge",
        zero="Zero recharge amount",
    ),
    revenue_frequency=Ladder(
        "total_rech_num_8",
        ((1, "1 recharge"), (2, "2 recharges"), (5, "3-5 recharges")),
        "6+ recharges",
        closed="right",
    ),
    amount_band=Ladder(
        "total_rech_amt_8", ((200, "Low amount"), (500, "Mid amount")), "High amount", zero="Zero amount"
    ),
    recharge_cell=Ladder(
        "total_rech_amt_8", ((200, "Low recharge"), (500, "Mid recharge")), "High recharge", zero="Zero recharge"
    ),
    revenue_value=Ladder(
        "arpu_8", ((200, "Lower value"), (500, "Mid value")), "Higher value", negative="Negative value"
    ),
)


@where
def has_tenure() -> Column:
    return C("aon").isNotNull()


@rule
def data_information() -> Column:
    unknown = C("date_of_last_rech_data_8").isNull() & C("total_rech_data_8").isNull()
    return first_match(
        (unknown, "Data-service information unavailable"), otherwise="Data-service information available"
    )


@rule
def label_text() -> Column:
    return C("label").cast("bigint")


@rule
def churn_status() -> Column:
    return first_match((C("label") == 1, "Churned"), (C("label") == 0, "Retained"), otherwise="Unknown")


@rule
def churn_or_retained() -> Column:
    return first_match((C("label") == 1, "Churned"), otherwise="Retained")


CONDITIONS.update(
    low_arpu=lambda: C("arpu_8") < 100,
    low_outgoing=lambda: C("total_og_mou_8") < 50,
    low_incoming=lambda: C("total_ic_mou_8") < 50,
    low_recharge=lambda: C("total_rech_amt_8") < 100,
    short_tenure=lambda: C("aon") < 365,
    no_voice=lambda: F.coalesce(C("voice_8"), F.lit(0.0)) == 0,
)


@rule
def activity_profile() -> Column:
    parts = [C("total_og_mou_8"), C("total_ic_mou_8"), C("total_rech_amt_8")]
    zero = every(parts, lambda c: F.coalesce(c.cast("double"), F.lit(0.0)) == 0)
    return first_match(
        (every(parts, is_null), "Activity information missing"),
        (zero, "Very low activity"),
        (C("activity_8") < 200, "Low activity"),
        (C("activity_8") < 700, "Moderate activity"),
        otherwise="High activity",
    )


@rule
def archetype() -> Column:
    activity = F.coalesce(C("activity_8"), F.lit(0.0))
    arpu = C("arpu_8")
    groups = {"High-value": arpu >= 500, "Mid-value": (arpu >= 200) & (arpu < 500), "Lower-value": arpu < 200}
    cases = []
    for name, hit in groups.items():
        cases += [
            (hit & (activity >= 700), f"{name} active"),
            (hit & (activity < 200), f"{name} low-engagement"),
        ]
    return first_match(*cases, otherwise="Other / insufficient information")


def _pair_zero(a: str, b: str) -> Column:
    return (C(a) == 0) & (C(b) == 0)


@rule
def voice_engagement() -> Column:
    return first_match(
        (C("voice_8").isNull(), "Voice usage missing"),
        (_pair_zero("total_og_mou_8", "total_ic_mou_8"), "Zero voice engagement"),
        (C("voice_8") < 100, "Very low"),
        (C("voice_8") < 400, "Low"),
        (C("voice_8") < 1000, "Moderate"),
        otherwise="High",
    )


def _dominance(a: str, b: str, labels: tuple[str, str, str, str, str]) -> Column:
    """Which of two usage parts is larger: (unknown, none, first, second, balanced)."""
    left, right = (F.coalesce(C(x), F.lit(0.0)) for x in (a, b))
    return first_match(
        (F.coalesce(C(a), C(b)).isNull(), labels[0]),
        (_pair_zero(a, b), labels[1]),
        (left > right, labels[2]),
        (right > left, labels[3]),
        otherwise=labels[4],
    )


@rule
def network_usage() -> Column:
    return _dominance(
        "onnet_mou_8",
        "offnet_mou_8",
        ("Usage information missing", "No network voice usage", "On-net dominant", "Off-net dominant", "Balanced"),
    )


@rule
def data_mix() -> Column:
    return _dominance(
        "vol_2g_mb_8",
        "vol_3g_mb_8",
        ("Data information missing", "No data usage", "2G dominant", "3G dominant", "Balanced 2G/3G"),
    )


@rule
def local_std() -> Column:
    local = either_total("loc_og_t2t_mou_8", "loc_og_t2m_mou_8")
    std = either_total("std_og_t2t_mou_8", "std_og_t2m_mou_8")
    near, far = F.coalesce(local, F.lit(0.0)), F.coalesce(std, F.lit(0.0))
    return first_match(
        (local.isNull() & std.isNull(), "Usage information missing"),
        (near + far == 0, "No local/STD outgoing usage"),
        (near > far, "Local dominant"),
        (far > near, "STD dominant"),
        otherwise="Balanced",
    )


@rule
def roaming() -> Column:
    return first_match(
        (C("roam_8").isNull(), "Roaming information missing"),
        (_pair_zero("roam_og_mou_8", "roam_ic_mou_8"), "No roaming usage"),
        (C("roam_8") < 50, "Low roaming usage"),
        (C("roam_8") < 200, "Moderate roaming usage"),
        otherwise="High roaming usage",
    )


@rule
def voice_balance() -> Column:
    og, ic = (F.coalesce(C(x), F.lit(0.0)) for x in ("total_og_mou_8", "total_ic_mou_8"))
    return first_match(
        (C("voice_8").isNull(), "Voice information missing"),
        (_pair_zero("total_og_mou_8", "total_ic_mou_8"), "No voice activity"),
        (og >= ic * 2, "Strongly outgoing-oriented"),
        (og > ic, "Outgoing-oriented"),
        (ic >= og * 2, "Strongly incoming-oriented"),
        (ic > og, "Incoming-oriented"),
        otherwise="Balanced",
    )


def _course(measure: str, edge: float, labels: tuple[str, ...]) -> Column:
    """Three-period course: unknown, all zero, all low, all active, rising, falling, mixed."""
    v = vector(measure)
    return first_match(
        (every(v, is_null), labels[0]),
        (every(v, is_zero), labels[1]),
        (every(v, lambda c: c < edge), labels[2]),
        (every(v, lambda c: c >= edge), labels[3]),
        (steps(measure, rising), labels[4]),
        (steps(measure, falling), labels[5]),
        otherwise=labels[6],
    )


# Labels of the three-period courses, in the order _course tests them.
CONSISTENCY = (
    "Consistently zero",
    "Consistently very low",
    "Consistently active",
    "Consistently increasing",
    "Consistently declining",
    "Mixed / variable",
)
TRAJECTORY = (
    "Insufficient information",
    "Consistently inactive",
    "Consistently low",
    "Persistently active",
    "Increasing trajectory",
    "Declining trajectory",
    "Variable trajectory",
)
RULES.update(
    voice_consistency=lambda: _course("voice", 100, ("Voice information missing", *CONSISTENCY)),
    data_consistency=lambda: _course("data", 10, ("Data information missing", *CONSISTENCY)),
    voice_trajectory=lambda: _course("voice", 100, TRAJECTORY),
)


def _latest_change(measure: str, unknown: str) -> Column:
    before, now = last_two(measure)
    return first_match(
        (before.isNull() | now.isNull(), unknown),
        ((before == 0) & (now == 0), "Zero in both months"),
        ((before == 0) & (now > 0), "Started/increased from zero"),
        ((now == 0) & (before > 0), "Dropped to zero"),
        (now < before * 0.5, "Severe decline (>50%)"),
        (now < before * 0.8, "Moderate decline (20-50%)"),
        (now < before, "Mild decline (<20%)"),
        (now == before, "No change"),
        otherwise="Increased",
    )


def _latest_direction(measure: str) -> Column:
    before, now = last_two(measure)
    return first_match(
        (before.isNull(), "Missing July information"),
        (now.isNull(), "Missing August information"),
        ((before > 0) & (now == 0), "Dropped to zero"),
        (now < before, "Declined"),
        otherwise="Stable / increased",
    )


RULES.update(
    voice_change=lambda: _latest_change("voice", "Insufficient voice information"),
    data_change=lambda: _latest_change("data", "Insufficient data information"),
    voice_direction=lambda: _latest_direction("voice"),
    data_direction=lambda: _latest_direction("data"),
)


@rule
def data_usage_level() -> Column:
    return first_match(
        (C("data_8").isNull(), "Data usage missing"),
        (_pair_zero("vol_2g_mb_8", "vol_3g_mb_8"), "Zero data usage"),
        (C("data_8") < 10, "Very low"),
        (C("data_8") < 100, "Low"),
        (C("data_8") < 500, "Moderate"),
        otherwise="High",
    )


@rule
def engagement_course() -> Column:
    """Voice and data activity give each period a score of 0 to 2."""
    known = vector("voice") + vector("data")
    score = [
        F.when(C(f"voice_{p}") > 0, 1).otherwise(0) + F.when(C(f"data_{p}") > 0, 1).otherwise(0) for p in (6, 7, 8)
    ]
    a, b, c = score
    return first_match(
        (every(known, is_null), "Insufficient information"),
        ((a == 0) & (b == 0) & (c == 0), "Consistently inactive"),
        ((a < b) & (b < c), "Increasing engagement"),
        ((a > b) & (b > c), "Declining engagement"),
        (c == 0, "Inactive in August"),
        ((a == b) & (b == c), "Stable engagement"),
        otherwise="Variable engagement",
    )


@rule
def joint_engagement() -> Column:
    voice, data = (F.coalesce(C(x), F.lit(0.0)) for x in ("voice_8", "data_8"))
    return first_match(
        ((voice == 0) & (data == 0), "Zero voice and data engagement"),
        ((voice < 100) & (data < 100), "Very low voice and data engagement"),
        ((voice < 400) & (data < 500), "Moderate engagement"),
        otherwise="Higher engagement",
    )


@rule
def revenue_engagement() -> Column:
    og, ic = C("total_og_mou_8"), C("total_ic_mou_8")
    return first_match(
        (og.isNull() | ic.isNull(), "Insufficient information"),
        (_pair_zero("total_og_mou_8", "total_ic_mou_8"), "No voice activity"),
        (og + ic < 100, "Low voice engagement"),
        (og + ic < 500, "Moderate voice engagement"),
        otherwise="Higher voice engagement",
    )


@rule
def arpu_change_band() -> Column:
    before, now = last_two("arpu")
    up = before > 0
    return first_match(
        ((before <= 0) & (now > 0), "Moved from non-positive to positive"),
        (up & (now <= 0), "Dropped to non-positive"),
        (up & (now < before * 0.5), "Severe decline"),
        (up & (now < before * 0.8), "Moderate decline"),
        (up & (now < before), "Mild decline"),
        (up & (now >= before * 1.2), "Strong increase"),
        (up & (now > before), "Increase"),
        (before == now, "No change"),
        otherwise="Insufficient information",
    )


@rule
def recharge_change_band() -> Column:
    before, now = last_two("total_rech_amt")
    up = before > 0
    return first_match(
        ((before == 0) & (now > 0), "Started recharging"),
        (up & (now == 0), "Dropped to zero"),
        (up & (now < before * 0.5), "Severe decline"),
        (up & (now < before * 0.8), "Moderate decline"),
        (up & (now < before), "Mild decline"),
        (now > before, "Increase"),
        (now == before, "No change"),
        otherwise="Insufficient information",
    )


@rule
def recharge_consistency() -> Column:
    v = vector("total_rech_amt")
    return first_match(
        (every(v, lambda c: c > 0), "Consistently positive"),
        (every(v, is_zero), "Consistently zero"),
        (steps("total_rech_amt", lambda a, b: a <= b) & (v[0] < v[2]), "Increasing"),
        (steps("total_rech_amt", lambda a, b: a >= b) & (v[0] > v[2]), "Declining"),
        otherwise="Variable",
    )


@rule
def high_value_threshold() -> Column:
    return first_match((C("arpu_8") >= 500, "Higher-value customer"), otherwise="Below higher-value threshold")


@rule
def value_recharge_signal() -> Column:
    before, now = last_two("total_rech_amt")
    high, low, paid = C("arpu_8") >= 500, C("arpu_8") < 500, before > 0
    return first_match(
        (high & paid & (now < before), "Higher-value + declining recharge"),
        (high & paid & (now >= before), "Higher-value + stable/increasing recharge"),
        (low & paid & (now < before), "Below higher-value + declining recharge"),
        otherwise="Other",
    )


@rule
def recharge_semantics() -> Column:
    n, amount = C("total_rech_num_8"), C("total_rech_amt_8")
    return first_match(
        ((n > 0) & (amount == 0), "Positive frequency + zero amount"),
        ((n > 0) & (amount > 0), "Positive frequency + positive amount"),
        ((n == 0) & (amount == 0), "Zero frequency + zero amount"),
        ((n == 0) & (amount > 0), "Zero frequency + positive amount"),
        otherwise="Other / insufficient information",
    )


CONDITIONS.update(
    high_arpu=lambda: C("arpu_8") >= 500,
    zero_recharge=lambda: C("total_rech_amt_8") == 0,
    high_arpu_falling_recharge=lambda: (C("arpu_8") >= 500)
    & (C("total_rech_amt_7") > 0)
    & (C("total_rech_amt_8") < C("total_rech_amt_7")),
    arpu_halved=lambda: (C("arpu_7") > 0) & (C("arpu_8") < C("arpu_7") * 0.5),
    recharge_halved=lambda: (C("total_rech_amt_7") > 0) & (C("total_rech_amt_8") < C("total_rech_amt_7") * 0.5),
)
