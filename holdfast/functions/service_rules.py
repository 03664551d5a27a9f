"""Bands and conditions of the service-adoption and temporal reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast import PERIODS
from holdfast.functions.bands import CONDITIONS, LADDERS, RULES, first_match, rule
from holdfast.functions.numeric import flag, sum_columns
from holdfast.functions.periods import every, falling, fell, is_null, is_zero, last_two, rising, some, steps, vector
from holdfast.specs import Ladder

C = F.col

UNAVAILABLE = "Information unavailable"
PACKS = ("monthly_2g_8", "sachet_2g_8", "monthly_3g_8", "sachet_3g_8")

LADDERS.update(
    data_recharge_status=Ladder(
        "total_rech_data_8",
        (),
        "Data recharge recorded",
        missing=UNAVAILABLE,
        zero="No recorded data recharge",
    ),
    temporal_value=Ladder(
        "arpu_8", ((100, "Low"), (250, "Medium"), (500, "High")), "Very High", missing="Unavailable"
    ),
)


def _adoption(column: str) -> Column:
    return first_match((C(column) == 1, "Adopted"), (C(column) == 0, "Not adopted"), otherwise=UNAVAILABLE)


def _packs(gen: str) -> Column:
    monthly, sachet = C(f"monthly_{gen.lower()}_8"), C(f"sachet_{gen.lower()}_8")
    return first_match(
        ((monthly > 0) & (sachet > 0), f"Monthly + Sachet {gen}"),
        (monthly > 0, f"Monthly {gen}"),
        (sachet > 0, f"Sachet {gen}"),
        ((monthly == 0) & (sachet == 0), f"No recorded {gen} service"),
        otherwise=UNAVAILABLE,
    )


def _any_pack(gen: str) -> Column:
    monthly, sachet = C(f"monthly_{gen.lower()}_8"), C(f"sachet_{gen.lower()}_8")
    return first_match(
        ((monthly > 0) | (sachet > 0), f"Any recorded {gen} service"),
        ((monthly == 0) & (sachet == 0), f"No recorded {gen} service"),
        otherwise=UNAVAILABLE,
    )


RULES.update(
    social_adoption=lambda: _adoption("fb_user_8"),
    night_adoption=lambda: _adoption("night_pck_user_8"),
    g2_packs=lambda: _packs("2G"),
    g3_packs=lambda: _packs("3G"),
    any_g2=lambda: _any_pack("2G"),
    any_g3=lambda: _any_pack("3G"),
)


@rule
def pack_mix() -> Column:
    monthly = (C("monthly_2g_8") > 0) | (C("monthly_3g_8") > 0)
    sachet = (C("sachet_2g_8") > 0) | (C("sachet_3g_8") > 0)
    return first_match(
        (monthly & sachet, "Monthly + Sachet services"),
        (monthly, "Monthly-oriented services"),
        (sachet, "Sachet-oriented services"),
        (every([C(c) for c in PACKS], is_zero), "No recorded pack adoption"),
        otherwise=UNAVAILABLE,
    )


@rule
def data_service_course() -> Column:
    v = vector("total_rech_data")
    first, second, third = v
    idle = some([first, second], lambda c: (c == 0) | c.isNull())
    return first_match(
        (every(v, lambda c: c > 0), "Consistently recorded data recharge"),
        (every(v, is_null), "No recorded information"),
        ((third > 0) & idle, "Recent data-service adoption"),
        ((third == 0) & ((first > 0) | (second > 0)), "Recent data-service reduction"),
        otherwise="Variable / incomplete trajectory",
    )


def _adopted() -> list[Column]:
    return [C("fb_user_8") == 1, C("night_pck_user_8") == 1, *[C(c) > 0 for c in PACKS], C("total_rech_data_8") > 0]


def service_breadth() -> Column:
    return sum_columns([flag(c) for c in _adopted()])


def _breadth_cases(n: Column) -> list[tuple[Column, str]]:
    return [
        (n == 0, "0 recorded services"),
        (n == 1, "1 recorded service"),
        (n == 2, "2 recorded services"),
        (n <= 4, "3-4 recorded services"),
    ]


@rule
def breadth_or_unknown() -> Column:
    fields = ("fb_user_8", "night_pck_user_8", *PACKS, "total_rech_data_8")
    unknown = every([C(c) for c in fields], is_null)
    return first_match((unknown, UNAVAILABLE), *_breadth_cases(service_breadth()), otherwise="5+ recorded services")


@rule
def breadth() -> Column:
    return first_match(*_breadth_cases(service_breadth()), otherwise="5+ recorded services")


@rule
def service_archetype() -> Column:
    *addons, data = _adopted()
    any_addon = sum_columns([flag(c) for c in addons]) > 0
    return first_match(
        (data & any_addon, "Multi-service adopter"),
        (data, "Data-service oriented"),
        (any_addon, "Pack / add-on oriented"),
        (C("total_rech_data_8") == 0, "Limited recorded adoption"),
        otherwise=UNAVAILABLE,
    )


def _three_period_adoption(name: str, measure: str, yes, no: str, adopted: str) -> Column:
    v = vector(measure)
    return first_match(
        (every(v, yes), f"{name} — {adopted}"),
        (every(v, is_zero), f"{name} — {no}"),
        (some(v, is_null), f"{name} — incomplete information"),
        otherwise=f"{name} — variable adoption",
    )


RULES.update(
    social_course=lambda: _three_period_adoption(
        "Social", "fb_user", lambda c: c == 1, "consistently not adopted", "consistently adopted"
    ),
    night_course=lambda: _three_period_adoption(
        "Night", "night_pck_user", lambda c: c == 1, "consistently not adopted", "consistently adopted"
    ),
    data_course=lambda: _three_period_adoption(
        "Data", "total_rech_data", lambda c: c > 0, "consistently no recorded recharge", "consistently recorded"
    ),
)

CONDITIONS.update(
    data_recharged=lambda: C("total_rech_data_8") > 0,
    data_unknown=lambda: C("total_rech_data_8").isNull(),
    social_user=lambda: C("fb_user_8") == 1,
    night_user=lambda: C("night_pck_user_8") == 1,
    g2_user=lambda: (C("monthly_2g_8") > 0) | (C("sachet_2g_8") > 0),
    g3_user=lambda: (C("monthly_3g_8") > 0) | (C("sachet_3g_8") > 0),
)


def _six_way(measure: str, unknown: str, up: str, july_up: str) -> Column:
    a, b, c = vector(measure)
    return first_match(
        (some([a, b, c], is_null), unknown),
        (steps(measure, rising), f"Consistently {up}"),
        (steps(measure, falling), "Consistently declining"),
        ((b > a) & (c < b), f"July {july_up}, August decline"),
        ((b < a) & (c > b), "July decline, August recovery"),
        otherwise="Mixed / stable",
    )


def _four_way(measure: str, unknown: str) -> Column:
    return first_match(
        (some(vector(measure), is_null), unknown),
        (steps(measure, rising), "Increasing"),
        (steps(measure, falling), "Declining"),
        otherwise="Mixed / stable",
    )


def _direction(change: str) -> Column:
    x = C(change)
    return first_match(
        (x > 0, "Increasing"), (x < 0, "Decreasing"), (x == 0, "No change"), otherwise="Unavailable"
    )


RULES.update(
    arpu_course=lambda: _six_way("arpu", "Incomplete ARPU history", "improving", "improvement"),
    recharge_course=lambda: _six_way("total_rech_amt", "Incomplete recharge history", "increasing", "increase"),
    outgoing_course=lambda: _four_way("total_og_mou", "Incomplete outgoing history"),
    incoming_course=lambda: _four_way("total_ic_mou", "Incomplete incoming history"),
    arpu_direction=lambda: _direction("arpu_change_6_8"),
    recharge_direction=lambda: _direction("recharge_change_6_8"),
)


@rule
def voice_change_pattern() -> Column:
    og6, og8, ic6, ic8 = (C(x) for x in ("total_og_mou_6", "total_og_mou_8", "total_ic_mou_6", "total_ic_mou_8"))
    return first_match(
        (some([og6, og8, ic6, ic8], is_null), "Incomplete history"),
        ((og8 < og6) & (ic8 < ic6), "Both declining"),
        (og8 < og6, "Outgoing declining only"),
        (ic8 < ic6, "Incoming declining only"),
        otherwise="Neither declining",
    )


@rule
def data_trajectory() -> Column:
    both = vector("vol_2g_mb") + vector("vol_3g_mb")
    return first_match(
        (some(both, is_null), "Incomplete data history"),
        (steps("vol_2g_mb", rising) & steps("vol_3g_mb", rising), "Consistently increasing"),
        (steps("vol_2g_mb", falling) & steps("vol_3g_mb", falling), "Consistently declining"),
        (fell("vol_2g_mb") & fell("vol_3g_mb"), "Recent decline"),
        otherwise="Mixed / stable",
    )


CORE = ("arpu", "total_rech_amt", "total_og_mou", "total_ic_mou")
"""Measures whose movement the temporal and priority reports follow."""


@rule
def deterioration_domains() -> Column:
    flags = [flag(fell(m)) for m in CORE] + [flag(fell("vol_2g_mb") & fell("vol_3g_mb"))]
    return sum_columns(flags).cast("bigint")


@rule
def persistent_declines() -> Column:
    return sum_columns([flag(steps(m, falling)) for m in CORE]).cast("bigint")


@rule
def temporal_profile() -> Column:
    pairs = [last_two(m) for m in CORE]
    down = sum_columns([flag(now < before) for before, now in pairs])
    up = sum_columns([flag(now > before) for before, now in pairs])
    known = sum_columns([flag(before.isNotNull() & now.isNotNull()) for before, now in pairs])
    return first_match(
        (known < 3, "Insufficient behavioral history"),
        ((down >= 3) & (down > up), "Declining"),
        ((up >= 3) & (up > down), "Improving"),
        ((down == 0) & (up == 0), "Stable"),
        otherwise="Mixed",
    )


@rule
def versus_baseline() -> Column:
    base = {m: (C(f"{m}_6") + C(f"{m}_7")) / 2.0 for m in CORE}
    return first_match(
        (some(list(base.values()), is_null), "Incomplete baseline"),
        (every(list(CORE), lambda m: C(f"{m}_8") < base[m]), "Broad deterioration vs baseline"),
        (every(list(CORE), lambda m: C(f"{m}_8") > base[m]), "Broad improvement vs baseline"),
        otherwise="Mixed / partial movement",
    )


def _broad(measures: tuple[str, ...]) -> tuple[Column, Column]:
    pairs = [last_two(m) for m in measures]
    return every(pairs, lambda p: p[1] < p[0]), every(pairs, lambda p: p[1] > p[0])


def _broad_band(measures: tuple[str, ...]) -> Column:
    down, up = _broad(measures)
    return first_match(
        (down, "Broad deterioration"), (up, "Broad improvement"), otherwise="Mixed / partial movement"
    )


RULES.update(
    broad_movement=lambda: _broad_band(CORE[:3]),
    broad_movement_all=lambda: _broad_band(CORE),
)
CONDITIONS.update(
    broad_deterioration=lambda: _broad(CORE[:3])[0],
    broad_improvement=lambda: _broad(CORE[:3])[1],
)


def incomplete(measure: str) -> Column:
    return some([C(f"{measure}_{p}") for p in PERIODS], is_null)
