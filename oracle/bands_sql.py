"""DuckDB text of every named band and condition, written apart from the Spark column functions.

Only the labels and edges of single-measure ladders are read from the library: they are data.
"""

from __future__ import annotations

from holdfast.functions import band_rules, service_rules, value_rules  # noqa: F401  (fills LADDERS)
from holdfast.functions.bands import LADDERS

M = (6, 7, 8)


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(*pairs: str, other: str) -> str:
    """case("cond => label", ..., other="label")"""
    body = " ".join(f"WHEN {c} THEN {text(label)}" for c, label in (p.split(" => ") for p in pairs))
    return f"CASE {body} ELSE {text(other)} END"


def ladder(name: str) -> str:
    lad = LADDERS[name]
    x, op = lad.measure, "<" if lad.closed == "left" else "<="
    whens = []
    if lad.missing is not None:
        whens.append(f"WHEN {x} IS NULL THEN {text(lad.missing)}")
    if lad.negative is not None:
        whens.append(f"WHEN {x} < 0 THEN {text(lad.negative)}")
    if lad.zero is not None:
        whens.append(f"WHEN {x} = 0 THEN {text(lad.zero)}")
    whens += [f"WHEN {x} {op} {edge} THEN {text(label)}" for edge, label in lad.steps]
    if not whens:
        return text(lad.top)
    return f"CASE {' '.join(whens)} ELSE {text(lad.top)} END"


def both(cond: str, *measures: str) -> str:
    return " AND ".join(cond.format(m) for m in measures)


def months(cond: str, join: str = " AND ") -> str:
    return "(" + join.join(cond.format(p) for p in M) + ")"


OG0 = "coalesce(total_og_mou_8, 0)"
IC0 = "coalesce(total_ic_mou_8, 0)"
V8 = "coalesce(voice_8, 0)"
D8 = "coalesce(data_8, 0)"
CORE = ("arpu", "total_rech_amt", "total_og_mou", "total_ic_mou")


def down(m: str) -> str:
    return f"{m}_8 < {m}_7"


def up(m: str) -> str:
    return f"{m}_8 > {m}_7"


def course(m: str, edge: int, labels: list[str]) -> str:
    return case(
        f"coalesce({m}_6, {m}_7, {m}_8) IS NULL => {labels[0]}",
        f"{months(m + '_{} = 0')} => {labels[1]}",
        f"{months(m + '_{} < ' + str(edge))} => {labels[2]}",
        f"{months(m + '_{} >= ' + str(edge))} => {labels[3]}",
        f"{m}_8 > {m}_7 AND {m}_7 > {m}_6 => {labels[4]}",
        f"{m}_8 < {m}_7 AND {m}_7 < {m}_6 => {labels[5]}",
        other=labels[6],
    )


STEADY = [
    "Consistently zero",
    "Consistently very low",
    "Consistently active",
    "Consistently increasing",
    "Consistently declining",
    "Mixed / variable",
]


def latest(m: str, unknown: str) -> str:
    a, b = f"{m}_7", f"{m}_8"
    return case(
        f"{a} + {b} IS NULL => {unknown}",
        f"{a} = 0 AND {b} = 0 => Zero in both months",
        f"{a} = 0 AND {b} > 0 => Started/increased from zero",
        f"{a} > 0 AND {b} = 0 => Dropped to zero",
        f"{b} < 0.5e0 * {a} => Severe decline (>50%)",
        f"{b} < 0.8e0 * {a} => Moderate decline (20-50%)",
        f"{b} < {a} => Mild decline (<20%)",
        f"{b} = {a} => No change",
        other="Increased",
    )


def heading(m: str) -> str:
    return case(
        f"{m}_7 IS NULL => Missing July information",
        f"{m}_8 IS NULL => Missing August information",
        f"{m}_7 > 0 AND {m}_8 = 0 => Dropped to zero",
        f"{down(m)} => Declined",
        other="Stable / increased",
    )


def bigger(a: str, b: str, unknown: str, none: str, first: str, second: str, same: str) -> str:
    return case(
        f"coalesce({a}, {b}) IS NULL => {unknown}",
        f"{a} = 0 AND {b} = 0 => {none}",
        f"coalesce({a}, 0) > coalesce({b}, 0) => {first}",
        f"coalesce({a}, 0) < coalesce({b}, 0) => {second}",
        other=same,
    )


def adoption(c: str) -> str:
    return case(f"{c} = 1 => Adopted", f"{c} = 0 => Not adopted", other="Information unavailable")


def packs(g: str) -> str:
    m, s = f"monthly_{g.lower()}_8", f"sachet_{g.lower()}_8"
    return case(
        f"{m} > 0 AND {s} > 0 => Monthly + Sachet {g}",
        f"{m} > 0 => Monthly {g}",
        f"{s} > 0 => Sachet {g}",
        f"{m} = 0 AND {s} = 0 => No recorded {g} service",
        other="Information unavailable",
    )


def anypack(g: str) -> str:
    m, s = f"monthly_{g.lower()}_8", f"sachet_{g.lower()}_8"
    return case(
        f"{m} > 0 OR {s} > 0 => Any recorded {g} service",
        f"{m} + {s} = 0 => No recorded {g} service",
        other="Information unavailable",
    )


ADOPTED = [
    "fb_user_8 = 1",
    "night_pck_user_8 = 1",
    "monthly_2g_8 > 0",
    "sachet_2g_8 > 0",
    "monthly_3g_8 > 0",
    "sachet_3g_8 > 0",
    "total_rech_data_8 > 0",
]


def hits(conds: list[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in conds) + ")"


BREADTH = hits(ADOPTED)
ADDONS = f"{hits(ADOPTED[:-1])} > 0"
BREADTH_STEPS = [
    f"{BREADTH} = 0 => 0 recorded services",
    f"{BREADTH} = 1 => 1 recorded service",
    f"{BREADTH} = 2 => 2 recorded services",
    f"{BREADTH} <= 4 => 3-4 recorded services",
]
FIELDS = "fb_user_8, night_pck_user_8, monthly_2g_8, sachet_2g_8, monthly_3g_8, sachet_3g_8, total_rech_data_8"


def threefold(name: str, m: str, yes: str, adopted: str, no: str) -> str:
    return case(
        f"{months(m + '_{} ' + yes)} => {name} — {adopted}",
        f"{months(m + '_{} = 0')} => {name} — {no}",
        f"{months(m + '_{} IS NULL', ' OR ')} => {name} — incomplete information",
        other=f"{name} — variable adoption",
    )


def sixway(m: str, unknown: str, rising: str, july: str) -> str:
    a, b, c = (f"{m}_{p}" for p in M)
    return case(
        f"{a} + {b} + {c} IS NULL => {unknown}",
        f"{a} < {b} AND {b} < {c} => Consistently {rising}",
        f"{a} > {b} AND {b} > {c} => Consistently declining",
        f"{a} < {b} AND {b} > {c} => July {july}, August decline",
        f"{a} > {b} AND {b} < {c} => July decline, August recovery",
        other="Mixed / stable",
    )


def fourway(m: str, unknown: str) -> str:
    a, b, c = (f"{m}_{p}" for p in M)
    return case(
        f"{a} + {b} + {c} IS NULL => {unknown}",
        f"{a} < {b} AND {b} < {c} => Increasing",
        f"{a} > {b} AND {b} > {c} => Declining",
        other="Mixed / stable",
    )


def sign(x: str) -> str:
    return case(f"{x} > 0 => Increasing", f"{x} < 0 => Decreasing", f"{x} = 0 => No change", other="Unavailable")


def levels(unknown: str, kind: str) -> str:
    return case(
        f"total_og_mou_8 IS NULL OR total_ic_mou_8 IS NULL => {unknown}",
        f"greatest(total_og_mou_8, total_ic_mou_8) < 10 => Very Low {kind}",
        f"greatest(total_og_mou_8, total_ic_mou_8) < 50 => Low {kind}",
        other=f"Active {kind}",
    )


def trend(*ms: str) -> str:
    history = " + ".join(f"{m}_{p}" for m in ms for p in M)
    steady = " AND ".join(f"{m}_8 >= {m}_7" for m in ms)
    if len(ms) == 1:
        steady += f" AND {ms[0]}_7 >= {ms[0]}_6"
    recent = " AND ".join(down(m) for m in ms)
    before = " AND ".join(f"{m}_7 < {m}_6" for m in ms)
    return case(
        f"{history} IS NULL => Incomplete Trend",
        f"{recent} AND {before} => Consistent Decline",
        f"{recent} => Recent Decline",
        f"{steady} => Stable / Improving",
        other="Mixed Trend",
    )


def broad(ms: tuple[str, ...]) -> str:
    return case(
        f"{' AND '.join(map(down, ms))} => Broad deterioration",
        f"{' AND '.join(map(up, ms))} => Broad improvement",
        other="Mixed / partial movement",
    )


DOWNS, UPS = hits([down(m) for m in CORE]), hits([up(m) for m in CORE])
KNOWN = hits([f"{m}_7 + {m}_8 IS NOT NULL" for m in CORE])
BASE = {m: f"({m}_6 + {m}_7) / 2e0" for m in CORE}
HIGH = "value_percentile >= 0.75"
SCORES = {p: f"((CASE WHEN voice_{p} > 0 THEN 1 ELSE 0 END) + (CASE WHEN data_{p} > 0 THEN 1 ELSE 0 END))" for p in M}

RULES: dict[str, str] = {
    "label_text": "CAST(label AS BIGINT)",
    "churn_status": case("label = 1 => Churned", "label = 0 => Retained", other="Unknown"),
    "churn_or_retained": case("label = 1 => Churned", other="Retained"),
    "data_information": case(
        "date_of_last_rech_data_8 IS NULL AND total_rech_data_8 IS NULL => Data-service information unavailable",
        other="Data-service information available",
    ),
    "activity_profile": case(
        "coalesce(total_og_mou_8, total_ic_mou_8, total_rech_amt_8) IS NULL => Activity information missing",
        f"{OG0} = 0 AND {IC0} = 0 AND coalesce(total_rech_amt_8, 0) = 0 => Very low activity",
        "activity_8 < 200 => Low activity",
        "activity_8 < 700 => Moderate activity",
        other="High activity",
    ),
    "archetype": case(
        "arpu_8 >= 500 AND activity_8 >= 700 => High-value active",
        "arpu_8 >= 500 AND coalesce(activity_8, 0) < 200 => High-value low-engagement",
        "arpu_8 >= 200 AND arpu_8 < 500 AND activity_8 >= 700 => Mid-value active",
        "arpu_8 >= 200 AND arpu_8 < 500 AND coalesce(activity_8, 0) < 200 => Mid-value low-engagement",
        "arpu_8 < 200 AND activity_8 >= 700 => Lower-value active",
        "arpu_8 < 200 AND coalesce(activity_8, 0) < 200 => Lower-value low-engagement",
        other="Other / insufficient information",
    ),
    "voice_engagement": case(
        "voice_8 IS NULL => Voice usage missing",
        "total_og_mou_8 = 0 AND total_ic_mou_8 = 0 => Zero voice engagement",
        "voice_8 < 100 => Very low",
        "voice_8 < 400 => Low",
        "voice_8 < 1000 => Moderate",
        other="High",
    ),
    "network_usage": bigger(
        "onnet_mou_8",
        "offnet_mou_8",
        "Usage information missing",
        "No network voice usage",
        "On-net dominant",
        "Off-net dominant",
        "Balanced",
    ),
    "data_mix": bigger(
        "vol_2g_mb_8",
        "vol_3g_mb_8",
        "Data information missing",
        "No data usage",
        "2G dominant",
        "3G dominant",
        "Balanced 2G/3G",
    ),
    "local_std": case(
        "coalesce(loc_og_t2t_mou_8, loc_og_t2m_mou_8, std_og_t2t_mou_8, std_og_t2m_mou_8) IS NULL"
        " => Usage information missing",
        "coalesce(loc_og_t2t_mou_8, 0) + coalesce(loc_og_t2m_mou_8, 0) + coalesce(std_og_t2t_mou_8, 0)"
        " + coalesce(std_og_t2m_mou_8, 0) = 0 => No local/STD outgoing usage",
        "coalesce(loc_og_t2t_mou_8, 0) + coalesce(loc_og_t2m_mou_8, 0) > coalesce(std_og_t2t_mou_8, 0)"
        " + coalesce(std_og_t2m_mou_8, 0) => Local dominant",
        "coalesce(loc_og_t2t_mou_8, 0) + coalesce(loc_og_t2m_mou_8, 0) < coalesce(std_og_t2t_mou_8, 0)"
        " + coalesce(std_og_t2m_mou_8, 0) => STD dominant",
        other="Balanced",
    ),
    "roaming": case(
        "coalesce(roam_og_mou_8, roam_ic_mou_8) IS NULL => Roaming information missing",
        "roam_og_mou_8 = 0 AND roam_ic_mou_8 = 0 => No roaming usage",
        "coalesce(roam_og_mou_8, 0) + coalesce(roam_ic_mou_8, 0) < 50 => Low roaming usage",
        "coalesce(roam_og_mou_8, 0) + coalesce(roam_ic_mou_8, 0) < 200 => Moderate roaming usage",
        other="High roaming usage",
    ),
    "voice_balance": case(
        "voice_8 IS NULL => Voice information missing",
        "total_og_mou_8 = 0 AND total_ic_mou_8 = 0 => No voice activity",
        f"{OG0} >= 2 * {IC0} => Strongly outgoing-oriented",
        f"{OG0} > {IC0} => Outgoing-oriented",
        f"{IC0} >= 2 * {OG0} => Strongly incoming-oriented",
        f"{IC0} > {OG0} => Incoming-oriented",
        other="Balanced",
    ),
    "voice_consistency": course("voice", 100, ["Voice information missing", *STEADY]),
    "data_consistency": course("data", 10, ["Data information missing", *STEADY]),
    "voice_trajectory": course(
        "voice",
        100,
        [
            "Insufficient information",
            "Consistently inactive",
            "Consistently low",
            "Persistently active",
            "Increasing trajectory",
            "Declining trajectory",
            "Variable trajectory",
        ],
    ),
    "voice_change": latest("voice", "Insufficient voice information"),
    "data_change": latest("data", "Insufficient data information"),
    "voice_direction": heading("voice"),
    "data_direction": heading("data"),
    "data_usage_level": case(
        "data_8 IS NULL => Data usage missing",
        "vol_2g_mb_8 = 0 AND vol_3g_mb_8 = 0 => Zero data usage",
        "data_8 < 10 => Very low",
        "data_8 < 100 => Low",
        "data_8 < 500 => Moderate",
        other="High",
    ),
    "engagement_course": case(
        "coalesce(voice_6, voice_7, voice_8, data_6, data_7, data_8) IS NULL => Insufficient information",
        f"{SCORES[6]} + {SCORES[7]} + {SCORES[8]} = 0 => Consistently inactive",
        f"{SCORES[6]} < {SCORES[7]} AND {SCORES[7]} < {SCORES[8]} => Increasing engagement",
        f"{SCORES[6]} > {SCORES[7]} AND {SCORES[7]} > {SCORES[8]} => Declining engagement",
        f"{SCORES[8]} = 0 => Inactive in August",
        f"{SCORES[6]} = {SCORES[7]} AND {SCORES[7]} = {SCORES[8]} => Stable engagement",
        other="Variable engagement",
    ),
    "joint_engagement": case(
        f"{V8} = 0 AND {D8} = 0 => Zero voice and data engagement",
        f"{V8} < 100 AND {D8} < 100 => Very low voice and data engagement",
        f"{V8} < 400 AND {D8} < 500 => Moderate engagement",
        other="Higher engagement",
    ),
    "revenue_engagement": case(
        "total_og_mou_8 IS NULL OR total_ic_mou_8 IS NULL => Insufficient information",
        "total_og_mou_8 = 0 AND total_ic_mou_8 = 0 => No voice activity",
        "total_og_mou_8 + total_ic_mou_8 < 100 => Low voice engagement",
        "total_og_mou_8 + total_ic_mou_8 < 500 => Moderate voice engagement",
        other="Higher voice engagement",
    ),
    "arpu_change_band": case(
        "arpu_7 <= 0 AND arpu_8 > 0 => Moved from non-positive to positive",
        "arpu_7 > 0 AND arpu_8 <= 0 => Dropped to non-positive",
        "arpu_7 > 0 AND arpu_8 < 0.5e0 * arpu_7 => Severe decline",
        "arpu_7 > 0 AND arpu_8 < 0.8e0 * arpu_7 => Moderate decline",
        "arpu_7 > 0 AND arpu_8 < arpu_7 => Mild decline",
        "arpu_7 > 0 AND arpu_8 >= 1.2e0 * arpu_7 => Strong increase",
        "arpu_7 > 0 AND arpu_8 > arpu_7 => Increase",
        "arpu_8 = arpu_7 => No change",
        other="Insufficient information",
    ),
    "recharge_change_band": case(
        "total_rech_amt_7 = 0 AND total_rech_amt_8 > 0 => Started recharging",
        "total_rech_amt_7 > 0 AND total_rech_amt_8 = 0 => Dropped to zero",
        "total_rech_amt_7 > 0 AND total_rech_amt_8 < 0.5e0 * total_rech_amt_7 => Severe decline",
        "total_rech_amt_7 > 0 AND total_rech_amt_8 < 0.8e0 * total_rech_amt_7 => Moderate decline",
        "total_rech_amt_7 > 0 AND total_rech_amt_8 < total_rech_amt_7 => Mild decline",
        "total_rech_amt_8 > total_rech_amt_7 => Increase",
        "total_rech_amt_8 = total_rech_amt_7 => No change",
        other="Insufficient information",
    ),
    "recharge_consistency": case(
        f"{months('total_rech_amt_{} > 0')} => Consistently positive",
        f"{months('total_rech_amt_{} = 0')} => Consistently zero",
        "total_rech_amt_7 BETWEEN total_rech_amt_6 AND total_rech_amt_8 AND total_rech_amt_6 < total_rech_amt_8"
        " => Increasing",
        "total_rech_amt_7 BETWEEN total_rech_amt_8 AND total_rech_amt_6 AND total_rech_amt_6 > total_rech_amt_8"
        " => Declining",
        other="Variable",
    ),
    "high_value_threshold": case("arpu_8 >= 500 => Higher-value customer", other="Below higher-value threshold"),
    "value_recharge_signal": case(
        "arpu_8 >= 500 AND total_rech_amt_7 > 0 AND total_rech_amt_8 < total_rech_amt_7"
        " => Higher-value + declining recharge",
        "arpu_8 >= 500 AND total_rech_amt_7 > 0 AND total_rech_amt_8 >= total_rech_amt_7"
        " => Higher-value + stable/increasing recharge",
        "arpu_8 < 500 AND total_rech_amt_7 > 0 AND total_rech_amt_8 < total_rech_amt_7"
        " => Below higher-value + declining recharge",
        other="Other",
    ),
    "recharge_semantics": case(
        "total_rech_num_8 > 0 AND total_rech_amt_8 = 0 => Positive frequency + zero amount",
        "total_rech_num_8 > 0 AND total_rech_amt_8 > 0 => Positive frequency + positive amount",
        "total_rech_num_8 = 0 AND total_rech_amt_8 = 0 => Zero frequency + zero amount",
        "total_rech_num_8 = 0 AND total_rech_amt_8 > 0 => Zero frequency + positive amount",
        other="Other / insufficient information",
    ),
    "social_adoption": adoption("fb_user_8"),
    "night_adoption": adoption("night_pck_user_8"),
    "g2_packs": packs("2G"),
    "g3_packs": packs("3G"),
    "any_g2": anypack("2G"),
    "any_g3": anypack("3G"),
    "pack_mix": case(
        "(monthly_2g_8 > 0 OR monthly_3g_8 > 0) AND (sachet_2g_8 > 0 OR sachet_3g_8 > 0)"
        " => Monthly + Sachet services",
        "monthly_2g_8 > 0 OR monthly_3g_8 > 0 => Monthly-oriented services",
        "sachet_2g_8 > 0 OR sachet_3g_8 > 0 => Sachet-oriented services",
        "monthly_2g_8 + sachet_2g_8 + monthly_3g_8 + sachet_3g_8 = 0 => No recorded pack adoption",
        other="Information unavailable",
    ),
    "data_service_course": case(
        f"{months('total_rech_data_{} > 0')} => Consistently recorded data recharge",
        "coalesce(total_rech_data_6, total_rech_data_7, total_rech_data_8) IS NULL => No recorded information",
        "total_rech_data_8 > 0 AND (coalesce(total_rech_data_6, 0) = 0 OR coalesce(total_rech_data_7, 0) = 0)"
        " => Recent data-service adoption",
        "total_rech_data_8 = 0 AND (total_rech_data_6 > 0 OR total_rech_data_7 > 0) => Recent data-service reduction",
        other="Variable / incomplete trajectory",
    ),
    "breadth_or_unknown": case(
        f"coalesce({FIELDS}) IS NULL => Information unavailable", *BREADTH_STEPS, other="5+ recorded services"
    ),
    "breadth": case(*BREADTH_STEPS, other="5+ recorded services"),
    "service_archetype": case(
        f"total_rech_data_8 > 0 AND {ADDONS} => Multi-service adopter",
        "total_rech_data_8 > 0 => Data-service oriented",
        f"{ADDONS} => Pack / add-on oriented",
        "total_rech_data_8 = 0 => Limited recorded adoption",
        other="Information unavailable",
    ),
    "social_course": threefold("Social", "fb_user", "= 1", "consistently adopted", "consistently not adopted"),
    "night_course": threefold("Night", "night_pck_user", "= 1", "consistently adopted", "consistently not adopted"),
    "data_course": threefold(
        "Data", "total_rech_data", "> 0", "consistently recorded", "consistently no recorded recharge"
    ),
    "arpu_course": sixway("arpu", "Incomplete ARPU history", "improving", "improvement"),
    "recharge_course": sixway("total_rech_amt", "Incomplete recharge history", "increasing", "increase"),
    "outgoing_course": fourway("total_og_mou", "Incomplete outgoing history"),
    "incoming_course": fourway("total_ic_mou", "Incomplete incoming history"),
    "arpu_direction": sign("arpu_8 - arpu_6"),
    "recharge_direction": sign("total_rech_amt_8 - total_rech_amt_6"),
    "voice_change_pattern": case(
        "total_og_mou_6 + total_og_mou_8 + total_ic_mou_6 + total_ic_mou_8 IS NULL => Incomplete history",
        "total_og_mou_8 < total_og_mou_6 AND total_ic_mou_8 < total_ic_mou_6 => Both declining",
        "total_og_mou_8 < total_og_mou_6 AND total_ic_mou_8 >= total_ic_mou_6 => Outgoing declining only",
        "total_og_mou_8 >= total_og_mou_6 AND total_ic_mou_8 < total_ic_mou_6 => Incoming declining only",
        other="Neither declining",
    ),
    "data_trajectory": case(
        f"{months('vol_2g_mb_{0} + vol_3g_mb_{0} IS NULL', ' OR ')} => Incomplete data history",
        "vol_2g_mb_6 < vol_2g_mb_7 AND vol_2g_mb_7 < vol_2g_mb_8 AND vol_3g_mb_6 < vol_3g_mb_7"
        " AND vol_3g_mb_7 < vol_3g_mb_8 => Consistently increasing",
        "vol_2g_mb_6 > vol_2g_mb_7 AND vol_2g_mb_7 > vol_2g_mb_8 AND vol_3g_mb_6 > vol_3g_mb_7"
        " AND vol_3g_mb_7 > vol_3g_mb_8 => Consistently declining",
        "vol_2g_mb_7 > vol_2g_mb_8 AND vol_3g_mb_7 > vol_3g_mb_8 => Recent decline",
        other="Mixed / stable",
    ),
    "deterioration_domains": "CAST("
    + hits([down(m) for m in CORE] + ["vol_2g_mb_8 < vol_2g_mb_7 AND vol_3g_mb_8 < vol_3g_mb_7"])
    + " AS BIGINT)",
    "persistent_declines": "CAST(" + hits([f"{m}_8 < {m}_7 AND {m}_7 < {m}_6" for m in CORE]) + " AS BIGINT)",
    "temporal_profile": case(
        f"{KNOWN} < 3 => Insufficient behavioral history",
        f"{DOWNS} >= 3 AND {DOWNS} > {UPS} => Declining",
        f"{UPS} >= 3 AND {UPS} > {DOWNS} => Improving",
        f"{DOWNS} + {UPS} = 0 => Stable",
        other="Mixed",
    ),
    "versus_baseline": case(
        f"{' + '.join(BASE.values())} IS NULL => Incomplete baseline",
        f"{' AND '.join(f'{m}_8 < {b}' for m, b in BASE.items())} => Broad deterioration vs baseline",
        f"{' AND '.join(f'{m}_8 > {b}' for m, b in BASE.items())} => Broad improvement vs baseline",
        other="Mixed / partial movement",
    ),
    "broad_movement": broad(CORE[:3]),
    "broad_movement_all": broad(CORE),
    "value_group": case(f"{HIGH} => High Value", other="Other Value"),
    "recharge_status": case(
        "total_rech_amt_7 + total_rech_amt_8 IS NULL => Recharge Trend Unavailable",
        f"{down('total_rech_amt')} => Declining Recharge",
        other="Stable / Increasing",
    ),
    "exposure_voice": levels("Usage Unavailable", "Voice Engagement"),
    "segment_voice": levels("Usage Unavailable", "Engagement"),
    "segment_engagement": levels("Engagement Unavailable", "Engagement"),
    "decline_status": case(
        "arpu_7 + arpu_8 + total_rech_amt_7 + total_rech_amt_8 IS NULL => Incomplete Trend",
        f"{down('arpu')} AND {down('total_rech_amt')} => ARPU + Recharge Decline",
        f"{down('arpu')} => ARPU Decline",
        f"{down('total_rech_amt')} => Recharge Decline",
        other="Stable / Improving",
    ),
    "segment_recharge": case(
        "total_rech_amt_8 IS NULL OR total_rech_num_8 IS NULL => Recharge Unavailable",
        "total_rech_amt_8 = 0 AND total_rech_num_8 = 0 => No Recharge",
        "total_rech_amt_8 < 100 OR total_rech_num_8 <= 2 => Low Recharge",
        "total_rech_amt_8 < 300 OR total_rech_num_8 <= 5 => Moderate Recharge",
        other="High Recharge",
    ),
    "executive_segment": case(
        f"{HIGH} AND engagement_group IN ('Very Low Engagement', 'Low Engagement') => High Value / Low Engagement",
        f"{HIGH} AND recharge_group IN ('No Recharge', 'Low Recharge') => High Value / Low Recharge",
        f"{HIGH} AND engagement_group = 'Active Engagement' AND recharge_group LIKE '%e Recharge'"
        " => High Value / Active",
        f"{HIGH} AND engagement_group = 'Active Engagement' AND recharge_group = 'High Recharge'"
        " => High Value / Active",
        f"NOT {HIGH} AND engagement_group IN ('Very Low Engagement', 'Low Engagement')"
        " => Other Value / Low Engagement",
        f"NOT {HIGH} AND recharge_group IN ('No Recharge', 'Low Recharge') => Other Value / Low Recharge",
        other="Other / Mixed",
    ),
    "low_engagement": "coalesce(total_og_mou_8 < 50 AND total_ic_mou_8 < 50, false)",
    "thin_recharge": "coalesce(total_rech_amt_8 < 100 OR total_rech_num_8 <= 2, false)",
    "priority_segment": case(
        f"{HIGH} AND low_engagement AND thin_recharge => High Value / Low Engagement + Low Recharge",
        f"{HIGH} AND low_engagement => High Value / Low Engagement",
        f"{HIGH} AND thin_recharge => High Value / Low Recharge",
        f"{HIGH} => High Value / Active",
        "low_engagement AND thin_recharge => Other Value / Low Engagement + Low Recharge",
        "low_engagement => Other Value / Low Engagement",
        "thin_recharge => Other Value / Low Recharge",
        other="Other / Active",
    ),
    "arpu_trend": trend("arpu"),
    "recharge_trend": trend("total_rech_amt"),
    "engagement_trend": trend("total_og_mou", "total_ic_mou"),
    "decline_signals": DOWNS,
    "deterioration_group": case(
        "decline_signals >= 2 => Multiple Deterioration Signals",
        "decline_signals = 1 => Single Deterioration Signal",
        other="Stable / No Detected Decline",
    ),
    "priority_cohort": case(
        f"{HIGH} AND decline_signals >= 2 => Priority Cohort",
        f"{HIGH} AND decline_signals = 1 => Elevated Cohort",
        f"NOT {HIGH} AND decline_signals >= 2 => Monitoring Cohort",
        other="Lower Priority",
    ),
    "value_quartile": "CASE value_quarter WHEN 1 THEN 'Q1 — Lowest Value' WHEN 2 THEN 'Q2 — Lower-Mid Value'"
    " WHEN 3 THEN 'Q3 — Upper-Mid Value' ELSE 'Q4 — Highest Value' END",
}

CONDITIONS: dict[str, str] = {
    "has_tenure": "aon IS NOT NULL",
    "low_arpu": "arpu_8 < 100",
    "low_outgoing": "total_og_mou_8 < 50",
    "low_incoming": "total_ic_mou_8 < 50",
    "low_recharge": "total_rech_amt_8 < 100",
    "short_tenure": "aon < 365",
    "no_voice": f"{OG0} + {IC0} = 0",
    "high_arpu": "arpu_8 >= 500",
    "zero_recharge": "total_rech_amt_8 = 0",
    "high_arpu_falling_recharge": f"arpu_8 >= 500 AND total_rech_amt_7 > 0 AND {down('total_rech_amt')}",
    "arpu_halved": "arpu_7 > 0 AND arpu_8 < 0.5e0 * arpu_7",
    "recharge_halved": "total_rech_amt_7 > 0 AND total_rech_amt_8 < 0.5e0 * total_rech_amt_7",
    "data_recharged": "total_rech_data_8 > 0",
    "data_unknown": "total_rech_data_8 IS NULL",
    "social_user": "fb_user_8 = 1",
    "night_user": "night_pck_user_8 = 1",
    "g2_user": "monthly_2g_8 > 0 OR sachet_2g_8 > 0",
    "g3_user": "monthly_3g_8 > 0 OR sachet_3g_8 > 0",
    "high_value": HIGH,
}


def band_sql(name: str) -> str:
    if name.startswith("const:"):
        return text(name.removeprefix("const:"))
    if name.startswith("col:"):
        return name.removeprefix("col:")
    return ladder(name) if name in LADDERS else RULES[name]
