"""Measures the reports share, derived from the raw panel columns. Unused ones cost nothing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import PERIODS
from holdfast.sources.panel import FIXTURE_CALENDAR, Calendar


def days_before(text_date: str, end: date) -> Column:
    """Days from an M/d/yyyy text date to ``end``; unreadable text is NULL."""
    return F.datediff(F.lit(end), F.try_to_date(F.col(text_date), "M/d/yyyy"))


def _total(*cols: str) -> str:
    """Missing parts count as zero unless every part is missing."""
    added = " + ".join(f"coalesce(cast({c} AS double), 0D)" for c in cols)
    return f"if(coalesce({', '.join(cols)}) IS NULL, NULL, {added})"


def _change(measure: str, start: int, end: int = 8) -> str:
    return f"({measure}_{end} - {measure}_{start})"


def with_measures(panel: DataFrame, cal: Calendar = FIXTURE_CALENDAR) -> DataFrame:
    totals = {}
    for p in PERIODS:
        totals[f"voice_{p}"] = _total(f"total_og_mou_{p}", f"total_ic_mou_{p}")
        totals[f"data_{p}"] = _total(f"vol_2g_mb_{p}", f"vol_3g_mb_{p}")
        totals[f"roam_{p}"] = _total(f"roam_og_mou_{p}", f"roam_ic_mou_{p}")
    totals["activity_8"] = _total("total_og_mou_8", "total_ic_mou_8", "total_rech_amt_8")
    totals["data_or_zero_8"] = "coalesce(vol_2g_mb_8, 0D) + coalesce(vol_3g_mb_8, 0D)"
    totals["value"] = "greatest(arpu_8, 0D)"
    changes = {}
    for name in ("voice", "data"):
        changes[f"{name}_change_pct"] = f"if({name}_7 > 0, {_change(name, 7)} * 100D / {name}_7, NULL)"
    for name, measure in {"arpu": "arpu", "recharge": "total_rech_amt"}.items():
        changes[f"{name}_change"] = _change(measure, 7)
        changes[f"{name}_change_pct"] = f"try_divide({_change(measure, 7)}, abs({measure}_7)) * 100D"
        changes[f"{name}_change_6_8"] = _change(measure, 6)
        changes[f"{name}_change_6_8_pct"] = f"try_divide({_change(measure, 6)}, {measure}_6) * 100D"
    out = panel.withColumns({k: F.expr(v) for k, v in totals.items()})
    out = out.withColumns({k: F.expr(v) for k, v in changes.items()})
    return out.withColumn("days_since_recharge_8", days_before("date_of_last_rech_8", cal.prediction_point))
