"""Behavioural features of a customer panel, as SQL expressions in dependency order.

Every feature is a row-wise expression, so the whole block is a projection: no shuffle, no UDF.
Layers exist only because later features use earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import PERIODS
from holdfast.operators.quantiles import medians_wide
from holdfast.sources.panel import FIXTURE_CALENDAR, Calendar

VOICE_BASES = (
    "total_og_mou",
    "total_ic_mou",
    "loc_og_mou",
    "std_og_mou",
    "isd_og_mou",
    "roam_og_mou",
    "loc_ic_mou",
    "std_ic_mou",
    "isd_ic_mou",
    "roam_ic_mou",
)
DATA_BASES = ("vol_2g_mb", "vol_3g_mb", "total_rech_data", "max_rech_data", "av_rech_amt_data")
SUMMARY_BASES: dict[str, str] = {
    "arpu": "arpu",
    "recharge_amount": "total_rech_amt",
    "recharge_count": "total_rech_num",
    **{b: b for b in VOICE_BASES + DATA_BASES},
}
"""Feature prefix -> panel measure of the three-period summaries."""

CHANGES: dict[str, tuple[str, tuple[int, ...]]] = {
    "arpu": ("arpu", (6, 7)),
    "recharge_amt": ("total_rech_amt", (6, 7)),
    "recharge_num": ("total_rech_num", (6,)),
    **{b: (b, (6, 7)) for b in VOICE_BASES},
    **{b: (b, (6,)) for b in DATA_BASES},
}
"""Feature prefix -> (measure, earlier periods compared with the last one)."""

TREND_BASES = {
    "arpu": "arpu",
    "recharge_amount": "total_rech_amt",
    "recharge_count": "total_rech_num",
    "total_activity": "total_activity",
}
DECLINE_PARTS = (
    "arpu_pct_change_6_to_8",
    "recharge_amt_pct_change_6_to_8",
    "recharge_num_pct_change_6_to_8",
    "total_activity_pct_change_6_to_8",
)
RECENCIES = {f"{kind}_rech_recency_{p}": (column, p)
             for kind, column in (("voice", "date_of_last_rech"), ("data", "date_of_last_rech_data"))
             for p in PERIODS}


def _three(measure: str) -> list[str]:
    return [f"cast({measure}_{p} AS double)" for p in PERIODS]


def summaries() -> dict[str, str]:
    """Mean, minimum and maximum of the periods that have a value."""
    out = {}
    for name, m in SUMMARY_BASES.items():
        v = _three(m)
        total = " + ".join(f"coalesce({x}, 0D)" for x in v)
        known = " + ".join(f"int({x} IS NOT NULL)" for x in v)
        out[f"{name}_avg_6_8"] = f"try_divide({total}, {known})"
        out[f"{name}_min_6_8"] = f"least({', '.join(v)})"
        out[f"{name}_max_6_8"] = f"greatest({', '.join(v)})"
    return out


def deviations() -> dict[str, str]:
    """Population standard deviation of the periods that have a value; needs the means."""
    out = {}
    for name, m in SUMMARY_BASES.items():
        v = _three(m)
        squares = " + ".join(f"coalesce(pow({x} - {name}_avg_6_8, 2), 0D)" for x in v)
        known = " + ".join(f"int({x} IS NOT NULL)" for x in v)
        out[f"{name}_std_6_8"] = f"sqrt(try_divide({squares}, {known}))"
    return out


def change(measure: str, start: int) -> str:
    return f"(cast({measure}_8 AS double) - {measure}_{start})"


def changes() -> dict[str, str]:
    return {
        f"{name}_change_{s}_to_8": change(m, s) for name, (m, starts) in CHANGES.items() for s in starts
    }


def percent_changes() -> dict[str, str]:
    """Change relative to the size of the earlier value; NULL when that is zero."""
    return {
        f"{name}_pct_change_{s}_to_8": f"try_divide({change(m, s)}, abs({m}_{s}))"
        for name, (m, starts) in CHANGES.items()
        for s in starts
    }


def monthly_totals() -> dict[str, str]:
    """Period totals that are NULL as soon as one part is."""
    out = {}
    for p in PERIODS:
        out[f"total_data_volume_{p}"] = f"vol_2g_mb_{p} + vol_3g_mb_{p}"
        out[f"total_voice_mou_{p}"] = f"total_og_mou_{p} + total_ic_mou_{p}"
        out[f"total_activity_{p}"] = f"total_og_mou_{p} + total_ic_mou_{p} + (vol_2g_mb_{p} + vol_3g_mb_{p})"
    return out


def activity_changes() -> dict[str, str]:
    out = {}
    for s in (6, 7):
        out[f"total_activity_change_{s}_to_8"] = change("total_activity", s)
        out[f"total_activity_pct_change_{s}_to_8"] = (
            f"try_divide({change('total_activity', s)}, abs(total_activity_{s}))"
        )
    return out


def inactivity() -> dict[str, str]:
    """1 when a known period total is zero; an unknown total counts as active."""
    out = {}
    for p in PERIODS:
        out[f"voice_inactive_{p}"] = f"int(coalesce(total_voice_mou_{p}, -1D) = 0)"
        out[f"data_inactive_{p}"] = f"int(coalesce(total_data_volume_{p}, -1D) = 0)"
    out["overall_inactive_8"] = "int(coalesce(total_voice_mou_8, -1D) = 0 AND coalesce(total_data_volume_8, -1D) = 0)"
    return out


def versus_baseline() -> dict[str, str]:
    """Last period against the three-period mean."""
    out = {}
    for name in ("arpu", "recharge_amount", "recharge_count"):
        gap = f"({SUMMARY_BASES[name]}_8 - {name}_avg_6_8)"
        out[f"{name}_recent_vs_baseline"] = gap
        out[f"{name}_recent_vs_baseline_pct"] = f"try_divide({gap}, abs({name}_avg_6_8))"
    return out


def value_ratios() -> dict[str, str]:
    """Amount per recharge (under its two names) and revenue per recharged amount."""
    per_recharge = "try_divide(total_rech_amt_8, total_rech_num_8)"
    return {
        "avg_recharge_amt_8": per_recharge,
        "recharge_value_per_transaction_8": per_recharge,
        "arpu_to_recharge_ratio_8": "try_divide(arpu_8, abs(total_rech_amt_8))",
    }


def no_recharge() -> dict[str, str]:
    out = {}
    for p in PERIODS:
        out[f"no_recharge_amt_{p}"] = f"int(coalesce(total_rech_amt_{p}, -1D) = 0)"
        out[f"no_recharge_count_{p}"] = f"int(coalesce(total_rech_num_{p}, -1) = 0)"
    return out


def decline_count() -> dict[str, str]:
    return {"behavioral_decline_count": " + ".join(f"int(coalesce({c} < 0, false))" for c in DECLINE_PARTS)}


def trend_scores() -> dict[str, str]:
    return {
        f"{name}_trend_score": f"cast(signum({m}_7 - {m}_6) + signum({m}_8 - {m}_7) AS double)"
        for name, m in TREND_BASES.items()
    }


def value_availability() -> dict[str, str]:
    parts = ("arpu_8", "total_rech_amt_8", "total_rech_num_8")
    return {"august_value_activity_flag": " + ".join(f"int({c} IS NOT NULL)" for c in parts)}


def tenure() -> dict[str, str]:
    """Years, and bands closed on the right: (0, 365], (365, 730], …"""
    return {
        "tenure_years": "aon / 365.25D",
        "tenure_band": "CASE WHEN aon < 0 OR aon IS NULL THEN NULL WHEN aon <= 365 THEN 'Under 1 Year'"
        " WHEN aon <= 730 THEN '1-2 Years' WHEN aon <= 1095 THEN '2-3 Years' WHEN aon <= 1825 THEN '3-5 Years'"
        " ELSE '5+ Years' END",
    }


def recencies(cal: Calendar = FIXTURE_CALENDAR) -> dict[str, str]:
    """Days from the last activity date of a period to its end."""
    return {
        name: f"datediff(DATE '{cal.orders[p][1]}', try_to_date({column}_{p}, 'M/d/yyyy'))"
        for name, (column, p) in RECENCIES.items()
    }


STRUCTURAL = (
    "total_rech_data",
    "max_rech_data",
    "av_rech_amt_data",
    "fb_user",
    "night_pck_user",
    "monthly_2g",
    "monthly_3g",
    "sachet_2g",
    "sachet_3g",
    "vol_3g_mb",
    "vol_2g_mb",
)
LATEST_VOICE = (
    "onnet_mou_8",
    "offnet_mou_8",
    "loc_og_t2t_mou_8",
    "loc_og_t2m_mou_8",
    "std_og_t2t_mou_8",
    "std_og_t2m_mou_8",
    *(f"{b}_8" for b in VOICE_BASES),
)
DATE_COLUMNS = tuple(f"{c}_{p}" for c in ("date_of_last_rech", "date_of_last_rech_data") for p in PERIODS)


def missing_indicators() -> dict[str, str]:
    """0/1 flags for data-service, latest-voice and date columns."""
    columns = [f"{m}_{p}" for m in STRUCTURAL for p in PERIODS] + list(LATEST_VOICE) + list(DATE_COLUMNS)
    return {f"{c}_missing": f"int({c} IS NULL)" for c in columns}


LAYERS = (
    lambda: tenure() | recencies() | summaries() | changes() | percent_changes() | monthly_totals() | value_ratios()
    | no_recharge() | value_availability() | missing_indicators(),
    lambda: deviations() | activity_changes() | inactivity() | versus_baseline(),
    lambda: decline_count() | trend_scores(),
)


def build_features(panel: DataFrame) -> DataFrame:
    """The panel with every feature added. Unused ones are pruned by the optimizer."""
    out = panel
    for layer in LAYERS:
        out = out.withColumns({k: F.expr(v) for k, v in layer().items()})
    return out


def feature_names() -> list[str]:
    return [name for layer in LAYERS for name in layer()]


def high_recency_flags(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """1 when a recency is above its median over ``fit`` (default: the whole table); unknown is 0."""
    middle = medians_wide(df if fit is None else fit, columns)
    named = middle.select("_one", *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(named), "_one", "left")
    flags = {f"{c}_high_flag": F.when(F.col(c) > F.col(f"_m_{c}"), 1).otherwise(0) for c in columns}
    return joined.withColumns(flags).drop("_one", *[f"_m_{c}" for c in columns])


def impute(df: DataFrame, medians: DataFrame, columns: list[str]) -> DataFrame:
    """Fill missing values from a one-row table of medians; a column without a median becomes 0."""
    named = medians.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(named), "_one", "left")
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns
    }
    return joined.withColumns(filled).drop("_one", *[f"_m_{c}" for c in columns])
