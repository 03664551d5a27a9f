"""Bands on hand-made rows: missing values, edges and the places where reports differ on purpose."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast import PERIODS
from holdfast.functions.bands import LADDERS, RULES, band
from holdfast.functions.measures import with_measures
from holdfast.functions.numeric import rounded
from holdfast.operators.features import build_features
from holdfast.plans import registry  # noqa: F401  (registers every band)

MEASURES = (
    "arpu total_rech_amt total_rech_num max_rech_amt total_og_mou total_ic_mou onnet_mou offnet_mou loc_og_t2t_mou"
    " loc_og_t2m_mou std_og_t2t_mou std_og_t2m_mou loc_og_mou std_og_mou isd_og_mou roam_og_mou loc_ic_mou std_ic_mou"
    " isd_ic_mou roam_ic_mou vol_2g_mb vol_3g_mb total_rech_data max_rech_data av_rech_amt_data fb_user night_pck_user"
    " monthly_2g sachet_2g monthly_3g sachet_3g"
).split()
TEXTS = ("date_of_last_rech", "date_of_last_rech_data", "last_date_of_month")
COLUMNS = [f"{m}_{p}" for m in MEASURES for p in PERIODS]
SCHEMA = ", ".join(
    ["id bigint", "label int", "aon int"] + [f"{c} double" for c in COLUMNS] + [f"{t}_{p} string" for t in TEXTS for p in PERIODS]
)


def panel(spark, rows):
    """Rows given as dicts; every column left out is NULL."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    data = [tuple({"id": i, "label": 0, **row}.get(n) for n in names) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def label_of(spark, name, rows):
    got = with_measures(panel(spark, rows)).select("id", band(name).alias("b")).orderBy("id").collect()
    return [r.b for r in got]


def test_missing_tenure_is_handled_per_report(spark):
    rows = [{"aon": None}, {"aon": 364}, {"aon": 365}, {"aon": 1825}]
    assert label_of(spark, "tenure_profile", rows) == ["5+ years", "Under 1 year", "1-2 years", "5+ years"]
    assert label_of(spark, "segment_tenure", rows) == ["Tenure Unavailable", "Under 1 Year", "1–2 Years", "5+ Years"]


def test_feature_tenure_is_closed_on_the_right(spark):
    rows = [{"aon": 0}, {"aon": 365}, {"aon": 366}, {"aon": 1825}, {"aon": 1826}, {"aon": None}, {"aon": -1}]
    got = build_features(panel(spark, rows)).select("id", "tenure_band").orderBy("id").collect()
    assert [r.tenure_band for r in got] == [
        "Under 1 Year", "Under 1 Year", "1-2 Years", "3-5 Years", "5+ Years", None, None,
    ]


def test_missing_value_falls_through_where_a_report_has_no_missing_band(spark):
    rows = [{}, {"arpu_8": -1.0}, {"arpu_8": 0.0}, {"arpu_8": 199.99}, {"arpu_8": 500.0}]
    assert label_of(spark, "revenue_arpu", rows) == [
        "Higher value", "Negative ARPU", "Zero ARPU", "Lower value", "Higher value",
    ]
    assert label_of(spark, "exposure_value", rows)[0] == "Very High"
    assert label_of(spark, "segment_value", rows)[0] == "Value Unavailable"


def test_voice_missing_means_both_or_either(spark):
    rows = [{"total_og_mou_8": 5.0}, {}, {"total_og_mou_8": 0.0, "total_ic_mou_8": 0.0}, {"total_og_mou_8": 0.0}]
    assert label_of(spark, "voice_engagement", rows) == [
        "Very low", "Voice usage missing", "Zero voice engagement", "Very low",
    ]
    assert label_of(spark, "revenue_engagement", rows) == [
        "Insufficient information", "Insufficient information", "No voice activity", "Insufficient information",
    ]


def test_totals_treat_missing_parts_in_two_ways(spark):
    df = panel(spark, [{"vol_2g_mb_8": 7.0, "total_og_mou_8": 1.0, "total_ic_mou_8": 2.0}])
    assert with_measures(df).first().data_8 == 7.0
    row = build_features(df).first()
    assert row.total_data_volume_8 is None
    assert row.total_activity_8 is None
    assert row.total_voice_mou_8 == 3.0
    assert row.data_inactive_8 == 0


def py_course(v, edge, labels):
    if all(x is None for x in v):
        return labels[0]
    known = all(x is not None for x in v)
    if known and all(x == 0 for x in v):
        return labels[1]
    if known and all(x < edge for x in v):
        return labels[2]
    if known and all(x >= edge for x in v):
        return labels[3]
    if known and v[0] < v[1] < v[2]:
        return labels[4]
    if known and v[0] > v[1] > v[2]:
        return labels[5]
    return labels[6]


def test_three_period_course_on_all_combinations(spark):
    options = (None, 0.0, 5.0, 99.0, 100.0, 250.0)
    combos = list(itertools.product(options, repeat=3))
    rows = [{f"total_og_mou_{p}": x for p, x in zip(PERIODS, v)} for v in combos]
    labels = (
        "Voice information missing", "Consistently zero", "Consistently very low", "Consistently active",
        "Consistently increasing", "Consistently declining", "Mixed / variable",
    )
    assert label_of(spark, "voice_consistency", rows) == [py_course(v, 100, labels) for v in combos]


def py_arpu_change(a, b):
    if a is None or b is None:
        return "Insufficient information"
    if a <= 0 < b:
        return "Moved from non-positive to positive"
    if a > 0:
        if b <= 0:
            return "Dropped to non-positive"
        if b < a * 0.5:
            return "Severe decline"
        if b < a * 0.8:
            return "Moderate decline"
        if b < a:
            return "Mild decline"
        if b >= a * 1.2:
            return "Strong increase"
        if b > a:
            return "Increase"
    return "No change" if a == b else "Insufficient information"


def test_change_ladder_on_all_combinations(spark):
    values = (None, -10.0, 0.0, 10.0, 49.0, 50.0, 80.0, 99.0, 100.0, 110.0, 120.0)
    combos = list(itertools.product(values, repeat=2))
    got = label_of(spark, "arpu_change_band", [{"arpu_7": a, "arpu_8": b} for a, b in combos])
    assert got == [py_arpu_change(a, b) for a, b in combos]


def test_temporal_profile_counts_domains(spark):
    core = ("arpu", "total_rech_amt", "total_og_mou", "total_ic_mou")
    combos = list(itertools.product((None, -1, 0, 1), repeat=4))
    rows = [
        {f"{m}_7": None if d is None else 10.0 for m, d in zip(core, c)}
        | {f"{m}_8": None if d is None else 10.0 + d for m, d in zip(core, c)}
        for c in combos
    ]

    def want(c):
        known = [d for d in c if d is not None]
        down, up = sum(d < 0 for d in known), sum(d > 0 for d in known)
        if len(known) < 3:
            return "Insufficient behavioral history"
        if down >= 3 and down > up:
            return "Declining"
        if up >= 3 and up > down:
            return "Improving"
        return "Stable" if down == up == 0 else "Mixed"

    assert label_of(spark, "temporal_profile", rows) == [want(c) for c in combos]
    declines = label_of(spark, "decline_signals", rows)
    assert declines == [sum(d is not None and d < 0 for d in c) for c in combos]


def test_trend_and_segments(spark):
    rows = [
        {"arpu_6": 3.0, "arpu_7": 2.0, "arpu_8": 1.0},
        {"arpu_6": 1.0, "arpu_7": 2.0, "arpu_8": 1.0},
        {"arpu_6": 1.0, "arpu_7": 1.0, "arpu_8": 2.0},
        {"arpu_6": 3.0, "arpu_7": 1.0, "arpu_8": 2.0},
        {"arpu_6": 3.0, "arpu_8": 2.0},
    ]
    assert label_of(spark, "arpu_trend", rows) == [
        "Consistent Decline", "Recent Decline", "Stable / Improving", "Mixed Trend", "Incomplete Trend",
    ]
    rows = [
        {"total_rech_amt_8": 0.0, "total_rech_num_8": 0.0},
        {"total_rech_amt_8": 500.0, "total_rech_num_8": 2.0},
        {"total_rech_amt_8": 500.0, "total_rech_num_8": 5.0},
        {"total_rech_amt_8": 500.0, "total_rech_num_8": 6.0},
        {"total_rech_amt_8": 500.0},
    ]
    assert label_of(spark, "segment_recharge", rows) == [
        "No Recharge", "Low Recharge", "Moderate Recharge", "High Recharge", "Recharge Unavailable",
    ]


def test_service_archetype_ignores_unknown_flags(spark):
    rows = [
        {"total_rech_data_8": 1.0, "fb_user_8": 1.0},
        {"total_rech_data_8": 1.0},
        {"total_rech_data_8": 0.0, "sachet_2g_8": 2.0},
        {"total_rech_data_8": 0.0},
        {},
    ]
    assert label_of(spark, "service_archetype", rows) == [
        "Multi-service adopter", "Data-service oriented", "Pack / add-on oriented", "Limited recorded adoption",
        "Information unavailable",
    ]


def test_three_month_features_skip_missing_periods(spark):
    df = build_features(panel(spark, [{"arpu_6": 1.0, "arpu_8": 4.0}, {}, {"arpu_7": -3.0}]))
    rows = df.select("id", *[f"arpu_{k}_6_8" for k in ("avg", "min", "max", "std")]).orderBy("id").collect()
    assert tuple(rows[0])[1:] == (2.5, 1.0, 4.0, 1.5)
    assert tuple(rows[1])[1:] == (None, None, None, None)
    assert tuple(rows[2])[1:] == (-3.0, -3.0, -3.0, 0.0)


def test_percent_change_uses_size_of_earlier_value(spark):
    rows = [{"arpu_6": -10.0, "arpu_8": -5.0}, {"arpu_6": 0.0, "arpu_8": 5.0}]
    got = build_features(panel(spark, rows)).orderBy("id").select("arpu_pct_change_6_to_8").collect()
    assert [r[0] for r in got] == [0.5, None]


def test_rounding_does_not_depend_on_sum_order(spark):
    values = [1.005, 2.675, 0.285, -0.125, 1e6 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    noisy = [r[0] for r in df.select(rounded(F.col("v") + 1e-13)).collect()]
    clean = [r[0] for r in df.select(rounded("v")).collect()]
    assert noisy == clean == [1.01, 2.68, 0.29, -0.12, 1000000.01]


def test_every_band_name_has_one_definition():
    assert not set(LADDERS) & set(RULES)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_band_labels_every_row(spark, seed):
    """Random rows with many gaps: each band gives a label (or a number), never NULL, except the raw label."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        row = {c: float(rng.integers(-3, 300)) for c in COLUMNS if rng.random() < 0.6}
        rows.append(row | {"aon": int(rng.integers(0, 3000)) if rng.random() < 0.8 else None})
    needs_rank = {
        "value_group", "executive_segment", "priority_segment", "deterioration_group", "priority_cohort", "value_quartile",
    }
    names = [n for n in (*LADDERS, *RULES) if n not in needs_rank and not n.startswith("test_")]
    df = with_measures(panel(spark, rows).withColumn("label", F.lit(1)))
    nulls = df.agg(*[F.count_if(band(n).isNull()).alias(n) for n in names]).first().asDict()
    assert {k for k, v in nulls.items() if v} == set()
