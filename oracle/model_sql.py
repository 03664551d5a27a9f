"""DuckDB text of features, missingness, selection, model comparison, calibration and attribution."""

from __future__ import annotations

import re

from oracle.panel_sql import LINE_CLASSES
from oracle.stages_sql import BINS, LEVEL, LOSS, N, SAFE, SCORED, SPLIT, STRATA, avg_rank, checks, div, drift_ctes, n_if, over, over_scores, pc, r, union_rows

M = (6, 7, 8)
KEY = "(id * 7919 + 104729) % 1000003"
SPLIT_PANEL = [STRATA.format(src="p"), SPLIT]


def over_split(body: str, *ctes: str) -> str:
    return over(body, *SPLIT_PANEL, *ctes)


TEXT = [f"{c}_{s}" for s in M for c in ("last_date_of_month", "date_of_last_rech", "date_of_last_rech_data")]
NUMBERS = ["aon", "circle_id"] + [
    f"{c}_{s}"
    for s in M
    for c in (
        "total_rech_num",
        "total_rech_amt",
        "max_rech_amt",
        "arpu",
        *LINE_CLASSES,
        "vol_2g_mb",
        "vol_3g_mb",
        "max_rech_data",
        "av_rech_amt_data",
        "fb_user",
        "night_pck_user",
        "total_rech_data",
        "monthly_2g",
        "sachet_2g",
        "monthly_3g",
        "sachet_3g",
    )
]
LATEST_VOICE = [f"{c}_8" for c in LINE_CLASSES]
SERVICE = (
    "total_rech_data max_rech_data av_rech_amt_data fb_user night_pck_user monthly_2g monthly_3g sachet_2g sachet_3g"
    " vol_3g_mb vol_2g_mb"
).split()
DATES = [f"{c}_{s}" for c in ("date_of_last_rech", "date_of_last_rech_data") for s in M]

NULLS = (
    "nl AS ("
    + union_rows(
        [
            f"'{c}' AS feature, split, label, count(*) AS n, count(*) FILTER ({c} IS NULL) AS mi,"
            f" {f'count(*) FILTER ({c} = 0)' if c in NUMBERS else '0'} AS ze FROM sp GROUP BY split, label"
            for c in NUMBERS + TEXT
        ]
    )
    + ")"
)
DEV, VAL = "split = 'development'", "split = 'validation'"
BYLABEL = (
    "bl AS (SELECT feature, sum(mi) AS mi, "
    + ", ".join(
        f"CAST(sum({x}) FILTER ({c}) AS DOUBLE) * 100 / sum(n) FILTER ({c}) AS {name}"
        for name, x, c in (
            ("rm", "mi", "label = 0"),
            ("cm", "mi", "label = 1"),
            ("rz", "ze", "label = 0"),
            ("cz", "ze", "label = 1"),
            ("am", "mi", "label >= 0"),
            ("az", "ze", "label >= 0"),
        )
    )
    + f" FROM nl WHERE {DEV} GROUP BY feature)"
)
UNIQUE = (
    "un AS ("
    + union_rows(
        [
            f"'{c}' AS feature, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT)"
            f" AS unique_count FROM sp WHERE {DEV}"
            for c in NUMBERS + TEXT
        ]
    )
    + ")"
)
SPREAD = (
    "sd AS ("
    + union_rows(
        [
            f"'{c}' AS feature, CAST(count(DISTINCT {c}) AS BIGINT) AS u, CAST(min({c}) AS DOUBLE) AS lo,"
            f" CAST(max({c}) AS DOUBLE) AS hi FROM sp WHERE {DEV}"
            for c in NUMBERS
        ]
        + [f"'{c}', NULL, NULL, NULL FROM sp WHERE {DEV} AND id < 0 GROUP BY id" for c in TEXT]
    )
    + ")"
)


def listed(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


IS_SERVICE = f"feature IN ({listed(f'{c}_{s}' for c in SERVICE for s in M)})"
IS_DATE = f"feature IN ({listed(DATES)})"
KIND = f"""CASE WHEN feature LIKE 'last_date_of_month%' THEN 'Calendar Metadata'
  WHEN unique_count <= 1 THEN 'Non-informative / Constant'
  WHEN {IS_DATE} THEN 'Date / Activity'
  WHEN {IS_SERVICE} AND mi = 0 THEN 'Data-Service / Complete'
  WHEN {IS_SERVICE} THEN 'Structural Data-Service Candidate'
  WHEN am > 0 AND am < 10 THEN 'Ordinary / Limited Missingness'
  WHEN am >= 10 THEN 'Unknown / Requires Investigation' ELSE 'No Missingness' END"""
TREATMENT = """CASE mechanism WHEN 'Calendar Metadata' THEN 'Exclude from modeling'
  WHEN 'Non-informative / Constant' THEN 'Exclude from modeling'
  WHEN 'Date / Activity' THEN CASE WHEN mi = 0 THEN 'Derive date-based features'
    ELSE 'Derive recency/activity features; do not use arbitrary date imputation' END
  WHEN 'Structural Data-Service Candidate' THEN
    'Confirm semantics before zero treatment; preserve missingness where informative'
  WHEN 'Ordinary / Limited Missingness' THEN
    'Assess necessity; controlled development-set imputation if required'
  WHEN 'Unknown / Requires Investigation' THEN 'Investigate business semantics before transformation'
  ELSE 'No missing-value treatment' END"""
INDICATOR = """CASE WHEN mechanism = 'Date / Activity' AND mi > 0 THEN 'Yes if activity state is informative'
  WHEN mechanism = 'Structural Data-Service Candidate' THEN 'Yes if informative'
  WHEN mechanism IN ('Date / Activity', 'Ordinary / Limited Missingness', 'Unknown / Requires Investigation')
  THEN 'Consider' ELSE 'No' END"""
STATUS = """CASE WHEN mechanism IN ('Structural Data-Service Candidate', 'Ordinary / Limited Missingness',
  'Unknown / Requires Investigation') THEN 'Pending Validation' ELSE 'Approved' END"""
TREATED = [
    NULLS,
    BYLABEL,
    UNIQUE,
    f"km AS (SELECT bl.*, unique_count, {KIND.replace('feature', 'bl.feature')} AS mechanism"
    " FROM bl JOIN un ON bl.feature = un.feature)",
]
FAMILY = """CASE WHEN feature = 'aon' OR feature LIKE '%tenure%' THEN 'Customer Tenure'
  WHEN regexp_matches(feature, 'arpu|revenue|value') THEN 'Customer Value'
  WHEN feature LIKE '%rech%' THEN 'Recharge Activity'
  WHEN regexp_matches(feature, 'voice|mou|og_|ic_') THEN 'Voice / Call Behavior'
  WHEN regexp_matches(feature, 'data|3g|2g|vol_') THEN 'Data Engagement'
  WHEN feature LIKE '%recency%' THEN 'Recency'
  WHEN regexp_matches(feature, 'trend|decline|deterioration') THEN 'Behavioral Trend'
  WHEN feature LIKE '%change%' THEN 'Temporal Change' WHEN feature LIKE '%baseline%' THEN 'Recent vs Baseline'
  WHEN regexp_matches(feature, 'inactive|activity') THEN 'Activity Signal'
  WHEN feature LIKE '%missing%' THEN 'Missingness Signal' ELSE 'Original / Other' END"""

# ---- features ------------------------------------------------------------------------------
VOICE = [
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
]
SERVICE5 = ["vol_2g_mb", "vol_3g_mb", "total_rech_data", "max_rech_data", "av_rech_amt_data"]
BASES = {"arpu": "arpu", "recharge_amount": "total_rech_amt", "recharge_count": "total_rech_num"}
BASES |= {b: b for b in VOICE + SERVICE5}


def known(m: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN {m}_{s} IS NULL THEN 0 ELSE 1 END)" for s in M) + ")"


def summed(m: str, f: str = "{}") -> str:
    return "(" + " + ".join(f"coalesce({f.format(f'CAST({m}_{s} AS DOUBLE)')}, 0)" for s in M) + ")"


def gap(m: str, s: int) -> str:
    return f"(CAST({m}_8 AS DOUBLE) - {m}_{s})"


def rel(m: str, s: int) -> str:
    return f"({gap(m, s)} / nullif(abs({m}_{s}), 0))"


SUMMARY, SPREADS, CHANGE, PCT = {}, {}, {}, {}
for name, m in BASES.items():
    SUMMARY[f"{name}_avg_6_8"] = f"{summed(m)} / nullif({known(m)}, 0)"
    SUMMARY[f"{name}_min_6_8"] = f"CAST(least({m}_6, {m}_7, {m}_8) AS DOUBLE)"
    SUMMARY[f"{name}_max_6_8"] = f"CAST(greatest({m}_6, {m}_7, {m}_8) AS DOUBLE)"
    square = f"(({{}} - {name}_avg_6_8) * ({{0}} - {name}_avg_6_8))".replace("{}", "{0}")
    SPREADS[f"{name}_std_6_8"] = f"sqrt({summed(m, square)} / nullif({known(m)}, 0))"
STARTS = {"arpu": ("arpu", M[:2]), "recharge_amt": ("total_rech_amt", M[:2]), "recharge_num": ("total_rech_num", M[:1])}
STARTS |= {b: (b, M[:2]) for b in VOICE} | {b: (b, M[:1]) for b in SERVICE5}
for name, (m, starts) in STARTS.items():
    for s in starts:
        CHANGE[f"{name}_change_{s}_to_8"] = gap(m, s)
        PCT[f"{name}_pct_change_{s}_to_8"] = rel(m, s)
TOTALS = {}
for s in M:
    TOTALS[f"total_data_volume_{s}"] = f"vol_2g_mb_{s} + vol_3g_mb_{s}"
    TOTALS[f"total_voice_mou_{s}"] = f"total_og_mou_{s} + total_ic_mou_{s}"
    TOTALS[f"total_activity_{s}"] = f"total_og_mou_{s} + total_ic_mou_{s} + (vol_2g_mb_{s} + vol_3g_mb_{s})"
ACTIVITY = {}
for s in M[:2]:
    ACTIVITY[f"total_activity_change_{s}_to_8"] = gap("total_activity", s)
    ACTIVITY[f"total_activity_pct_change_{s}_to_8"] = rel("total_activity", s)


def bit(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


INACTIVE = {}
for s in M:
    INACTIVE[f"voice_inactive_{s}"] = bit(f"total_voice_mou_{s} = 0")
    INACTIVE[f"data_inactive_{s}"] = bit(f"total_data_volume_{s} = 0")
INACTIVE["overall_inactive_8"] = bit("total_voice_mou_8 = 0 AND total_data_volume_8 = 0")
RECENT = {}
for name in ("arpu", "recharge_amount", "recharge_count"):
    RECENT[f"{name}_recent_vs_baseline"] = f"({BASES[name]}_8 - {name}_avg_6_8)"
    RECENT[f"{name}_recent_vs_baseline_pct"] = f"({BASES[name]}_8 - {name}_avg_6_8) / nullif(abs({name}_avg_6_8), 0)"
RATIOS = {
    "avg_recharge_amt_8": "total_rech_amt_8 / nullif(total_rech_num_8, 0)",
    "recharge_value_per_transaction_8": "total_rech_amt_8 / nullif(total_rech_num_8, 0)",
    "arpu_to_recharge_ratio_8": "arpu_8 / nullif(abs(total_rech_amt_8), 0)",
}
NONE = {}
for s in M:
    NONE[f"no_recharge_amt_{s}"] = bit(f"total_rech_amt_{s} = 0")
    NONE[f"no_recharge_count_{s}"] = bit(f"total_rech_num_{s} = 0")
DECLINE = {
    "behavioral_decline_count": " + ".join(
        f"({bit(f'{c}_pct_change_6_to_8 < 0')})" for c in ("arpu", "recharge_amt", "recharge_num", "total_activity")
    )
}
TREND = {
    f"{name}_trend_score": f"CAST(sign({m}_7 - {m}_6) + sign({m}_8 - {m}_7) AS DOUBLE)"
    for name, m in {
        "arpu": "arpu",
        "recharge_amount": "total_rech_amt",
        "recharge_count": "total_rech_num",
        "total_activity": "total_activity",
    }.items()
}
AVAILABLE = {
    "august_value_activity_flag": " + ".join(
        f"({bit(f'{c} IS NOT NULL')})" for c in ("arpu_8", "total_rech_amt_8", "total_rech_num_8")
    )
}
TENURE = {
    "tenure_years": "aon / 365.25e0",
    "tenure_band": "CASE WHEN aon BETWEEN 0 AND 365 THEN 'Under 1 Year' WHEN aon BETWEEN 366 AND 730 THEN '1-2 Years'"
    " WHEN aon BETWEEN 731 AND 1095 THEN '2-3 Years' WHEN aon BETWEEN 1096 AND 1825 THEN '3-5 Years'"
    " WHEN aon > 1825 THEN '5+ Years' END",
}
ENDS = {6: "1998-12-31", 7: "1999-12-31", 8: "2000-12-31"}


def day(c: str) -> str:
    return f"CAST(strptime({c}, '%m/%d/%Y') AS DATE)"


RECENCY = {
    f"{k}_rech_recency_{s}": f"CAST(DATE '{ENDS[s]}' - {day(f'{c}_{s}')} AS INTEGER)"
    for k, c in (("voice", "date_of_last_rech"), ("data", "date_of_last_rech_data"))
    for s in M
}
FLAGS = {
    f"{c}_missing": bit(f"{c} IS NULL") for c in [f"{b}_{s}" for b in SERVICE for s in M] + LATEST_VOICE + DATES
}


def layer(name: str, source: str, *blocks: dict[str, str]) -> str:
    cols = ", ".join(f"{sql} AS {k}" for b in blocks for k, sql in b.items())
    return f"{name} AS (SELECT *, {cols} FROM {source})"


FEATURE_CTES = [
    layer("f1", "{src}", TENURE, RECENCY, SUMMARY, CHANGE, PCT, TOTALS, RATIOS, NONE, AVAILABLE, FLAGS),
    layer("f2", "f1", SPREADS, ACTIVITY, INACTIVE, RECENT),
    layer("f3", "f2", DECLINE, TREND),
]


def feature_ctes(source: str) -> list[str]:
    return [FEATURE_CTES[0].replace("{src}", source), *FEATURE_CTES[1:]]


WHOLE = set(FLAGS) | set(NONE) | set(INACTIVE) | set(AVAILABLE) | set(DECLINE) | set(RECENCY) | {"tenure_band"}


def block(*blocks: dict[str, str]) -> str:
    cols = ", ".join(k if k in WHOLE else f"{r(k)} AS {k}" for b in blocks for k in b)
    return over(f"SELECT id, {cols} FROM f3", *feature_ctes("p"))


MODEL = (
    "aon arpu_7 arpu_8 total_rech_amt_7 total_rech_amt_8 total_rech_num_7 total_rech_num_8 max_rech_amt_8 total_og_mou_8"
    " total_ic_mou_8 onnet_mou_8 offnet_mou_8 voice_rech_recency_8 arpu_avg_6_8 arpu_std_6_8 arpu_change_7_to_8"
    " recharge_amount_min_6_8 recharge_amt_change_6_to_8 total_og_mou_change_7_to_8 total_ic_mou_change_7_to_8"
    " recharge_count_trend_score behavioral_decline_count no_recharge_count_8 total_voice_mou_8"
).split()
MATRIX = [
    *SPLIT_PANEL,
    *feature_ctes("sp"),
    "md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) FILTER ({DEV}) AS m_{c}" for c in MODEL) + " FROM f3)",
    "fl AS (SELECT id, label, split, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}, 0) AS {c}" for c in MODEL) + " FROM f3, md)",
    f"dv AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {KEY}, id) - 1) % 5 + 1 AS fold FROM fl WHERE {DEV})",
]


def over_matrix(body: str, *ctes: str) -> str:
    return over(body, *MATRIX, *ctes)


def spearman(source: str, cols: list[str]) -> list[str]:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}" for c in cols)
    pairs = union_rows(
        [
            f"'{a}' AS feature_1, '{b}' AS feature_2, {r(f'abs(corr({a}, {b}))')} AS abs_spearman_correlation FROM rn"
            for i, a in enumerate(cols)
            for b in cols[i + 1 :]
        ]
    )
    return [
        f"rn AS (SELECT {ranks} FROM {source})",
        f"pr AS ({pairs})",
        "pq AS (SELECT * FROM pr WHERE abs_spearman_correlation IS NOT NULL AND NOT isnan(abs_spearman_correlation))",
    ]


EDGES = [
    "eg AS (SELECT feature_1 AS a, feature_2 AS b FROM pq WHERE abs_spearman_correlation >= 0.9"
    " UNION SELECT feature_2, feature_1 FROM pq WHERE abs_spearman_correlation >= 0.9)",
    "rc AS (SELECT a, b FROM eg UNION SELECT rc.a, eg.b FROM rc JOIN eg ON rc.b = eg.a)",
    "cc AS (SELECT a AS feature, least(a, min(b)) AS root FROM rc GROUP BY a)",
    "gg AS (SELECT feature, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS group_id FROM cc)",
]


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


PREFERENCE = (
    "(CASE WHEN regexp_matches(gg.feature, 'change|trend|ratio|baseline|flag|avg_|min_|max_|std_') THEN 0e0 ELSE 3e0 END"
    " + CASE WHEN gg.feature LIKE '%\\_8%' ESCAPE '\\' THEN 2e0 ELSE 0e0 END"
    " + CASE WHEN regexp_matches(gg.feature, 'arpu|aon|total_rech|total_og|total_ic|vol_2g|vol_3g') THEN 2e0 ELSE 0e0 END"
    " + greatest(0e0, 1e0 - pm / 100e0))"
)
INDICATORS = ["arpu_6", "arpu_7", "arpu_8", "fb_user_8", "max_rech_data_8", "aon"]
PAIRED = [f"{m}_{s}" for m in ("total_rech_data", "max_rech_data", "fb_user") for s in M] + ["arpu_6", "arpu_7", "arpu_8"]

# ---- scores of several models --------------------------------------------------------------
CARDS = {
    "Blend card": "1.1e0 + (-0.55e0) * coalesce(total_rech_num_8, 0) + (-0.35e0) * coalesce(total_rech_num_7, 0)"
    " + (-0.0015e0) * coalesce(arpu_8, 0) + (-0.002e0) * coalesce(total_og_mou_8, 0) + (-0.0003e0) * coalesce(aon, 0)",
    "Recharge card": "0.6e0 + (-0.6e0) * coalesce(total_rech_num_8, 0) + (-0.3e0) * coalesce(total_rech_num_7, 0)",
    "Value card": "-0.2e0 + (-0.002e0) * coalesce(arpu_8, 0) + (-0.001e0) * coalesce(total_og_mou_8, 0)",
}
CARD_CTES = [
    *SPLIT_PANEL,
    f"fo AS (SELECT *, CASE WHEN {DEV} THEN (row_number() OVER (PARTITION BY split, label ORDER BY {KEY}, id) - 1) % 5 + 1 END AS fold FROM sp)",
    "cr AS ("
    + union_rows(
        [f"'{k}' AS model, id, label, split, fold, {r(f'1e0 / (1e0 + exp(-({z})))')} AS score FROM fo" for k, z in CARDS.items()]
    )
    + ")",
]


def newton(penalty: str) -> list[str]:
    """CTEs that end in nf: slope w and intercept b of a logistic fit of the label on the score's log-odds."""
    return [
        f"lz AS (SELECT id, label, ln({SAFE} / (1 - {SAFE})) AS z FROM (SELECT id, label, score AS raw_probability FROM sc))",
        "nw AS (SELECT 0 AS k, 0e0 AS w, 0e0 AS b UNION ALL"
        " SELECT k + 1, w + (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b + (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) FROM ("
        f"SELECT k, w, b, sum((label - p) * z) - {penalty} * w AS gw, sum(label - p) AS gb, sum(p * (1 - p) * z * z) + {penalty} AS hww,"
        " sum(p * (1 - p) * z) AS hwb, sum(p * (1 - p)) AS hbb"
        " FROM (SELECT k, w, b, label, z, 1e0 / (1e0 + exp(-(w * z + b))) AS p FROM nw, lz WHERE k < 25) GROUP BY k, w, b))",
        "nf AS (SELECT w, b FROM nw WHERE k = 25)",
    ]


FILLED = re.sub(r"coalesce\((\w+), 0\)", r"coalesce(CAST(\1 AS DOUBLE), m_\1)", CARDS["Blend card"])
CARD_COLUMNS = re.findall(r"coalesce\((\w+), 0\)", CARDS["Blend card"])


def evaluated(name: str, source: str, by: str) -> list[str]:
    """CTEs that end in ``name``: all metrics of ``source`` per group."""
    w = f"OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"
    join = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in by.split(", "))
    prec = "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)"
    rec = "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)"
    tops = ", ".join(
        f"{r(div(f'count(*) FILTER (label = 1 AND pos <= greatest(ceil(size * {t} / 100e0), 1))', 'sum(label)'))} AS top_{t}_capture,"
        f" {r('(' + div(f'count(*) FILTER (label = 1 AND pos <= greatest(ceil(size * {t} / 100e0), 1))', f'max(greatest(ceil(size * {t} / 100e0), 1))') + ' / ' + div('sum(label)', 'count(*)') + ')')} AS top_{t}_lift"
        for t in (5, 10, 20)
    )
    cols = ", ".join(f"{name}a.{k} AS {k}" for k in by.split(", "))
    return [
        f"{name}g AS (SELECT {by}, score, count(*) AS n, sum(label) AS pos FROM {source} GROUP BY {by}, score)",
        f"{name}c AS (SELECT *, sum(n) {w} AS cn, sum(pos) {w} AS cp FROM {name}g)",
        f"{name}a AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(pos) AS BIGINT) AS churners,"
        f" {r(div('sum((n - pos) * (cp - pos + pos / 2e0))', 'sum(pos) * (sum(n) - sum(pos))'))} AS roc_auc,"
        f" {r(div('sum(pos * (CAST(cp AS DOUBLE) / cn))', 'sum(pos)'))} AS pr_auc FROM {name}c GROUP BY {by})",
        f"{name}b AS (SELECT {by}, {r(f'avg({LOSS})')} AS log_loss, {r('avg((score - label) * (score - label))')} AS brier_score,"
        f" {n_if('score >= 0.5 AND label = 1')} AS tp, {n_if('score < 0.5 AND label = 0')} AS tn,"
        f" {n_if('score >= 0.5 AND label = 0')} AS fp, {n_if('score < 0.5 AND label = 1')} AS fn FROM {source} GROUP BY {by})",
        f"{name}k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id) AS pos, count(*) OVER (PARTITION BY {by}) AS size FROM {source})",
        f"{name}t AS (SELECT {by}, {tops} FROM {name}k GROUP BY {by})",
        f"{name} AS (SELECT {cols}, rows, churners, roc_auc, pr_auc, log_loss, brier_score, {r(prec)} AS precision, {r(rec)} AS recall,"
        f" {r(f'coalesce(2e0 * {prec} * {rec} / nullif({prec} + {rec}, 0), 0)')} AS f1, {r(div('tp + tn', 'rows'))} AS accuracy,"
        f" {r(div('tp + fp', 'rows'))} AS predicted_churn_rate, {r(div('churners', 'rows'))} AS fold_churn_rate,"
        + ", ".join(f" top_{t}_capture, top_{t}_lift" for t in (5, 10, 20))
        + f" FROM {name}a JOIN {name}b ON {join.format(name + 'a', name + 'b')} JOIN {name}t ON {join.format(name + 'a', name + 't')})",
    ]


FOLDS = [*CARD_CTES, "cf AS (SELECT * FROM cr WHERE fold IS NOT NULL)", *evaluated("ev", "cf", "model, fold")]
METRICS = (
    "pr_auc roc_auc precision recall f1 log_loss brier_score predicted_churn_rate top_10_capture top_10_lift"
).split()
SUMMARY_SELECT = (
    f"SELECT model, {N} AS folds, "
    + ", ".join(
        f"{r(f'avg({m})')} AS {m}_mean, {r(f'stddev_samp({m})')} AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max"
        for m in METRICS
    )
    + f", row_number() OVER (ORDER BY {r('avg(pr_auc)')} DESC, model) AS pr_auc_rank FROM ev GROUP BY model"
)
PAIR_ROWS = union_rows(
    [
        f"'{a}' AS model_a, '{b}' AS model_b, x.pr_auc AS a, y.pr_auc AS b FROM ev x JOIN ev y ON x.fold = y.fold"
        f" WHERE x.model = '{a}' AND y.model = '{b}'"
        for a, b in (("Blend card", "Recharge card"), ("Blend card", "Value card"), ("Recharge card", "Value card"))
    ]
)
HOLDOUT = [
    *FOLDS,
    f"hv AS (SELECT * FROM cr WHERE {VAL})",
    *evaluated("ho", "hv", "model"),
    f"cv AS (SELECT model, {r('avg(pr_auc)')} AS cv_pr_auc FROM ev GROUP BY model)",
    "hc AS (SELECT ho.model AS model, cv_pr_auc, pr_auc AS validation_pr_auc, roc_auc AS validation_roc_auc,"
    " precision AS precision_at_0_50, recall AS recall_at_0_50, f1 AS f1_at_0_50, log_loss, brier_score, top_10_capture,"
    f" top_10_lift, {r('(pr_auc - cv_pr_auc)')} AS validation_minus_cv_pr_auc,"
    f" {r('abs(pr_auc - cv_pr_auc)')} AS absolute_cv_validation_gap,"
    " row_number() OVER (ORDER BY pr_auc DESC, ho.model) AS validation_rank,"
    " max(pr_auc) OVER () - pr_auc <= 0.002000001e0 AS within_pr_auc_0_002_of_best FROM ho JOIN cv ON ho.model = cv.model)",
]

# ---- attribution ---------------------------------------------------------------------------
WEIGHTS = {
    "total_rech_num_8": "-0.55e0",
    "total_rech_num_7": "-0.35e0",
    "arpu_8": "-0.0015e0",
    "total_og_mou_8": "-0.002e0",
    "aon": "-0.0003e0",
}
ATTRIBUTION = [
    *SPLIT_PANEL,
    "z0 AS (SELECT id, label, split, "
    + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in WEIGHTS)
    + f", {r('1e0 / (1e0 + exp(-(' + CARDS['Blend card'] + ')))')} AS score FROM sp)",
    "zb AS (SELECT " + ", ".join(f"avg({c}) FILTER ({DEV}) AS b_{c}" for c in WEIGHTS) + " FROM z0)",
    "zl AS ("
    + union_rows([f"id, score, '{c}' AS feature, {c} AS v, ({w}) * ({c} - b_{c}) AS x FROM z0, zb" for c, w in WEIGHTS.items()])
    + ")",
    f"zs AS (SELECT id, score, feature, v, {r('x')} AS x FROM zl)",
    "zd AS (SELECT *, CASE WHEN x > 0 THEN 'positive' ELSE 'negative' END AS side, row_number() OVER"
    " (PARTITION BY id, x > 0 ORDER BY abs(x) DESC, feature) AS place FROM zs WHERE x <> 0)",
]


def over_attribution(body: str) -> str:
    return over(body, *ATTRIBUTION)


def drivers(side: str) -> str:
    return f"coalesce(string_agg(CASE WHEN side = '{side}' THEN place || '. ' || feature END, ' | ' ORDER BY place), '')"


EDGE_MI = "ed AS (SELECT feature, " + ", ".join(f"quantile_cont(v, 0.{i}) AS q{i}" for i in range(1, 10)) + " FROM lg WHERE v IS NOT NULL GROUP BY feature)"
MI = [
    *SPLIT_PANEL,
    *feature_ctes("sp"),
    "lg AS (" + union_rows([f"label, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM f3 WHERE {DEV}" for c in MODEL]) + ")",
    EDGE_MI,
    "bn AS (SELECT lg.feature AS feature, label, CASE WHEN v IS NULL THEN -1 ELSE "
    + " + ".join(f"(CASE WHEN v > q{i} THEN 1 ELSE 0 END)" for i in range(1, 10))
    + " END AS bin FROM lg LEFT JOIN ed ON lg.feature = ed.feature)",
    "ce AS (SELECT feature, bin, label, CAST(count(*) AS DOUBLE) AS n FROM bn GROUP BY feature, bin, label)",
    "cw AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb,"
    " sum(n) OVER (PARTITION BY feature, label) AS nl FROM ce)",
    f"ci AS (SELECT feature, {r('sum(n / t * ln(n / (nb * nl / t)))')} AS mutual_information FROM cw GROUP BY feature)",
]
def psi(x: str) -> str:
    """digamma by six steps of the recurrence and the asymptotic series."""
    y = f"({x} + 6e0)"
    steps = " + ".join(f"1e0 / ({x} + {i}e0)" for i in range(6))
    return f"(ln({y}) - 1e0 / (2e0 * {y}) - 1e0 / (12e0 * {y}**2) + 1e0 / (120e0 * {y}**4) - 1e0 / (252e0 * {y}**6) - ({steps}))"


_SIDES = [f"{f}(v, {j}) OVER w" for f in ("lag", "lead") for j in (1, 2, 3)]
# All columns of the panel but id and label, as they stand.
PANEL_ORDER = ["aon", "circle_id"] + [
    f"{c}_{s}"
    for s in M
    for c in (
        "last_date_of_month date_of_last_rech total_rech_num total_rech_amt max_rech_amt arpu total_og_mou total_ic_mou onnet_mou offnet_mou"
        " loc_og_t2t_mou loc_og_t2m_mou std_og_t2t_mou std_og_t2m_mou loc_og_mou std_og_mou isd_og_mou roam_og_mou loc_ic_mou std_ic_mou"
        " isd_ic_mou roam_ic_mou vol_2g_mb vol_3g_mb date_of_last_rech_data max_rech_data av_rech_amt_data fb_user night_pck_user"
        " total_rech_data monthly_2g sachet_2g monthly_3g sachet_3g"
    ).split()
]
BUILT = [k for b in (TENURE, RECENCY, SUMMARY, CHANGE, PCT, TOTALS, RATIOS, NONE, AVAILABLE, FLAGS, SPREADS, ACTIVITY, INACTIVE, RECENT, DECLINE, TREND) for k in b]
EVERY = NUMBERS + [k for k in BUILT if k != "tenure_band"]
NULL_PAIRS = [
    "lf AS (" + union_rows([f"id, {i} AS k, '{c}' AS feature, {bit(f'{c} IS NULL')} AS f FROM sp WHERE {DEV}" for i, c in enumerate(PANEL_ORDER)]) + ")",
    "pr AS (SELECT a.feature AS feature_1, b.feature AS feature_2, corr(a.f, b.f) AS x FROM lf a JOIN lf b ON a.id = b.id AND a.k < b.k GROUP BY ALL)",
    "pq AS (SELECT * FROM pr WHERE x IS NOT NULL AND NOT isnan(x))",
]
KINDS = {c: "double" for c in NUMBERS} | {c: "string" for c in TEXT}
KINDS |= {c: "int" for c in ("aon", "circle_id", "label")} | {f"{c}_{s}": "int" for c in ("fb_user", "night_pck_user") for s in M}
KINDS |= {f"{c}_{s}": "bigint" for c in "total_rech_num total_rech_data monthly_2g sachet_2g monthly_3g sachet_3g".split() for s in M} | {"id": "bigint"}
NEAREST = [
    *MATRIX,
    "lg AS (" + union_rows([f"id, label, '{c}' AS feature, {c} AS v FROM dv" for c in MODEL]) + ")",
    "nb AS (SELECT *, list_sort(list_filter([" + ", ".join(f"abs(v - {side})" for side in _SIDES) + "], lambda x: x IS NOT NULL)) AS ds,"
    " count(*) OVER (PARTITION BY feature, label) AS nc FROM lg WINDOW w AS (PARTITION BY feature, label ORDER BY v, id))",
    "kd AS (SELECT *, least(3, nc - 1) AS k, ds[least(3, nc - 1)] AS d FROM nb WHERE nc > 1)",
    "qd AS (SELECT DISTINCT feature, v, d FROM kd)",
    "vn AS (SELECT feature, v, count(*) AS n FROM kd GROUP BY feature, v)",
    "md2 AS (SELECT q.feature, q.v, q.d, sum(b.n) AS m FROM qd q JOIN vn b ON q.feature = b.feature"
    " AND ((q.d > 0 AND b.v > q.v - q.d AND b.v < q.v + q.d) OR (q.d = 0 AND b.v = q.v)) GROUP BY ALL)",
    "tt AS (SELECT kd.feature AS feature, count(*) AS n, sum("
    + f"{psi('CAST(kd.k AS DOUBLE)')} - {psi('CAST(kd.nc AS DOUBLE)')} - {psi('CAST(md2.m AS DOUBLE)')}) AS s"
    " FROM kd JOIN md2 ON kd.feature = md2.feature AND kd.v = md2.v AND kd.d = md2.d GROUP BY kd.feature)",
    f"ni AS (SELECT feature, {r('greatest(0e0, ' + psi('CAST(n AS DOUBLE)') + ' + s / n)')} AS mutual_information FROM tt)",
]
STABILITY = [
    *MATRIX,
    "lg AS (" + union_rows([f"label, fold, '{c}' AS feature, {c} AS v FROM dv" for c in MODEL]) + ")",
    "vg AS (SELECT feature, fold, v, count(*) AS n, sum(label) AS pos FROM lg GROUP BY feature, fold, v)",
    "vc AS (SELECT *, sum(pos) OVER (PARTITION BY feature, fold ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS cp FROM vg)",
    "va AS (SELECT feature, fold, sum((n - pos) * (cp - pos + pos / 2e0)) / (CAST(sum(pos) AS DOUBLE) * (sum(n) - sum(pos))) AS a"
    " FROM vc GROUP BY feature, fold)",
    f"vf AS (SELECT feature, {r('greatest(a, 1 - a)', 9)} AS a FROM va)",
]
CONTRACT = checks(
    "p",
    {
        "Rows present": "count(*) > 0",
        "Customer IDs present": "count(id) = count(*)",
        "Customer IDs unique": "count(DISTINCT id) = count(*)",
        "Label present": "count(label) = count(*)",
        "Label binary": "count(*) FILTER (label IN (0, 1)) = count(*)",
        "Both classes present": "min(label) = 0 AND max(label) = 1",
    },
    wrap=over,
)
AUDIT = {
    "feature_count": "max(24e0)",
    "development_rows": f"CAST(count(*) FILTER ({DEV}) AS DOUBLE)",
    "validation_rows": f"CAST(count(*) FILTER ({VAL}) AS DOUBLE)",
    "development_churn_rate": r(f"avg(label) FILTER ({DEV})"),
    "validation_churn_rate": r(f"avg(label) FILTER ({VAL})"),
    "class_ratio_majority_to_minority": r(
        f"(CAST(count(*) FILTER ({DEV} AND label = 0) AS DOUBLE) / count(*) FILTER ({DEV} AND label = 1))"
    ),
    "initial_threshold": "max(0.5e0)",
    "random_state": "max(42e0)",
    "development_missing_values": f"CAST(count(*) FILTER ({DEV} AND {' + '.join(MODEL)} IS NULL) AS DOUBLE)",
    "validation_missing_values": f"CAST(count(*) FILTER ({VAL} AND {' + '.join(MODEL)} IS NULL) AS DOUBLE)",
    "development_infinite_values": f"CAST(count(*) FILTER ({DEV} AND isinf({' + '.join(MODEL)})) AS DOUBLE)",
    "validation_infinite_values": f"CAST(count(*) FILTER ({VAL} AND isinf({' + '.join(MODEL)})) AS DOUBLE)",
}
SANITY_COLUMNS = [
    k
    for b in (TENURE, RECENCY, SUMMARY, CHANGE, PCT, TOTALS, RATIOS, NONE, AVAILABLE, FLAGS, SPREADS, ACTIVITY, INACTIVE, RECENT, DECLINE, TREND)
    for k in b
    if k != "tenure_band"
]
DUMMY = [
    *SPLIT_PANEL,
    f"dr AS (SELECT avg(label) FILTER ({DEV}) AS rate FROM sp)",
    f"du AS (SELECT 'Most Frequent' AS model, id, label, CASE WHEN rate > 0.5 THEN 1e0 ELSE 0e0 END AS score FROM sp, dr WHERE {VAL}"
    f" UNION ALL SELECT 'Prior Probability', id, label, {r('rate')} FROM sp, dr WHERE {VAL})",
    *evaluated("de", "du", "model"),
]
CALIBRATED = r(f"1e0 / (1e0 + exp(-(0.9e0 * ln({SAFE} / (1 - {SAFE})) + (-0.1e0))))").replace("raw_probability", "score")
STAGED = [
    SCORED,
    STRATA.format(src="sc"),
    SPLIT,
    f"sg AS (SELECT 'before_calibration' AS stage, id, label, score FROM sp WHERE {VAL}"
    f" UNION ALL SELECT 'after_calibration', id, label, {CALIBRATED} FROM sp WHERE {VAL})",
    *evaluated("se", "sg", "stage"),
    f"sb AS (SELECT stage, {BINS} AS bin, count(*) AS n, avg(score) AS a, avg(label) AS b FROM sg GROUP BY 1, 2)",
    f"sx AS (SELECT stage, {r('sum(n * abs(a - b)) / sum(n)')} AS ece FROM sb GROUP BY stage)",
    f"sy AS (SELECT stage, {r('avg(score)')} AS mean_predicted_probability, {r('avg(label)')} AS actual_churn_rate FROM sg GROUP BY stage)",
]

PICK = (
    "SELECT group_id, feature, CASE WHEN place = 1 THEN 'Retain' ELSE 'Exclude' END AS decision,"
    " max(CASE WHEN place = 1 THEN feature END) OVER (PARTITION BY group_id) AS representative,"
    " CASE WHEN place = 1 THEN 'Preferred representative of highly correlated group'"
    " ELSE 'Highly correlated redundant feature' END AS reason FROM gp"
)


def picked(columns: list[str]) -> list[str]:
    shares = [f"'{c}' AS feature, count(*) FILTER ({c} IS NULL) * 100e0 / count(*) AS pm FROM f3 WHERE {DEV}" for c in columns]
    return [
        "pm AS (" + union_rows(shares) + ")",
        f"gp AS (SELECT group_id, gg.feature AS feature, row_number() OVER (PARTITION BY group_id ORDER BY {PREFERENCE} DESC,"
        " gg.feature DESC) AS place FROM gg JOIN pm ON gg.feature = pm.feature)",
    ]


PAIRS_OF_ALL = [
    *SPLIT_PANEL,
    *feature_ctes("sp"),
    "md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) FILTER ({DEV}) AS m_{c}" for c in EVERY) + " FROM f3)",
    "lv AS ("
    + union_rows([f"id, {i} AS k, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), m_{c}, 0) AS v FROM f3, md WHERE {DEV}" for i, c in enumerate(sorted(EVERY))])
    + ")",
    "rk AS (SELECT id, k, feature, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2e0 AS x FROM lv)",
    "pr AS (SELECT a.feature AS feature_1, b.feature AS feature_2, corr(a.x, b.x) AS x FROM rk a JOIN rk b ON a.id = b.id AND a.k < b.k GROUP BY ALL)",
    f"pq AS (SELECT feature_1, feature_2, {r('abs(x)')} AS abs_spearman_correlation FROM pr WHERE x IS NOT NULL AND NOT isnan(x))",
]

STAGES: dict[str, str] = {
    "f01_ingest_contract": CONTRACT,
    "f03_missingness_profile": over_split(
        f"SELECT feature, CAST(sum(mi) AS BIGINT) AS missing_count, CAST(sum(n) AS BIGINT) AS total_rows,"
        f" {r(pc('sum(mi)', 'sum(n)'), 4)} AS missing_pct, CASE WHEN sum(mi) = 0 THEN '0%'"
        f" WHEN {pc('sum(mi)', 'sum(n)')} < 10 THEN '0–10%' WHEN {pc('sum(mi)', 'sum(n)')} < 30 THEN '10–30%'"
        f" WHEN {pc('sum(mi)', 'sum(n)')} < 70 THEN '30–70%' ELSE '≥70%' END AS missingness_band"
        f" FROM nl WHERE {DEV} GROUP BY feature",
        NULLS,
    ),
    "f04_missingness_stability": over_split(
        f"SELECT feature, {r('d', 4)} AS development_missing_pct, {r('v', 4)} AS validation_missing_pct,"
        f" {r('abs(d - v)', 4)} AS absolute_difference_pct, CASE WHEN abs(d - v) > 5 THEN 'Review' ELSE 'Stable' END AS stability_flag FROM c",
        NULLS,
        f"c AS (SELECT feature, {pc(f'sum(mi) FILTER ({DEV})', f'sum(n) FILTER ({DEV})')} AS d,"
        f" {pc(f'sum(mi) FILTER ({VAL})', f'sum(n) FILTER ({VAL})')} AS v FROM nl GROUP BY feature)",
    ),
    "f05_missingness_by_label": over_split(
        f"SELECT feature, {r('rm', 4)} AS retained_missing_pct, {r('cm', 4)} AS churned_missing_pct,"
        f" {r('abs(cm - rm)', 4)} AS absolute_difference_pct, CASE WHEN cm > rm THEN 'Higher in churned'"
        " WHEN cm < rm THEN 'Higher in retained' ELSE 'Equal' END AS direction FROM bl",
        NULLS,
        BYLABEL,
    ),
    "f06_high_missing_profile": over_split(
        f"SELECT bl.feature AS feature, {r('am', 4)} AS missing_pct, {r('az', 4)} AS zero_pct, {r('(100 - am - az)', 4)} AS non_zero_pct,"
        " coalesce(u, 0) AS unique_non_missing, lo AS min_non_missing, hi AS max_non_missing,"
        f" {r('rm', 4)} AS retained_missing_pct, {r('cm', 4)} AS churned_missing_pct, {r('(cm - rm)', 4)} AS difference_pct"
        " FROM bl LEFT JOIN sd ON bl.feature = sd.feature WHERE am >= 70",
        NULLS,
        BYLABEL,
        SPREAD,
    ),
    "f07_voice_zero_vs_missing": over_split(
        f"SELECT feature, {r('rm', 4)} AS retained_missing_pct, {r('cm', 4)} AS churned_missing_pct,"
        f" {r('(cm - rm)', 4)} AS missing_difference_pct, {r('rz', 4)} AS retained_zero_pct, {r('cz', 4)} AS churned_zero_pct"
        f" FROM bl WHERE feature IN ({listed(LATEST_VOICE)})",
        NULLS,
        BYLABEL,
    ),
    "c01_sigmoid_calibrate": recursive(
        over_scores(
            f"SELECT id, {r('greatest(least(1e0 / (1e0 + exp(-(w * z + b))), 1 - 1e-7), 1e-7)', 5)} AS score FROM lz, nf",
            *newton("1e0"),
        )
    ),
    "c05_slope_intercept": recursive(
        over_scores(
            f"SELECT 'score' AS \"column\", (SELECT count(*) FROM lz) AS customers, {r('w', 4)} AS calibration_slope,"
            f" {r('b', 4)} AS calibration_intercept FROM nf",
            *newton("0e0"),
        )
    ),
    "m17_schema_fingerprint": over(
        f"SELECT {N} AS rows, sha256('aon:int,arpu_8:double,id:bigint,label:int') AS schema_hash,"
        " bit_xor(h) AS content_xor, CAST(sum(h % 1000003) AS BIGINT) AS content_sum FROM hs",
        "hs AS (SELECT CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(aon AS VARCHAR), 'NULL'), coalesce(CAST(arpu_8 AS VARCHAR), 'NULL'),"
        " coalesce(CAST(id AS VARCHAR), 'NULL'), coalesce(CAST(label AS VARCHAR), 'NULL'))), 1, 15) AS BIGINT) AS h FROM p)",
    ),
    "m17_schema_fingerprint_all": over(
        f"SELECT {N} AS rows, sha256('" + ",".join(f"{c}:{KINDS[c]}" for c in sorted(KINDS)) + "') AS schema_hash,"
        " bit_xor(h) AS content_xor, CAST(sum(h % 1000003) AS BIGINT) AS content_sum FROM hs",
        "hs AS (SELECT CAST('0x' || substr(md5(concat_ws('|', "
        + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in sorted(KINDS))
        + ")), 1, 15) AS BIGINT) AS h FROM p)",
    ),
    "f08_missingness_correlation_all": over_split(f"SELECT feature_1, feature_2, {r('x')} AS correlation FROM pq", *NULL_PAIRS),
    "f33_indicator_redundancy_all": over_split(
        f"SELECT feature_1 || '_missing' AS feature_1, feature_2 || '_missing' AS feature_2, {r('abs(x)')} AS abs_spearman_correlation FROM pq",
        *NULL_PAIRS,
    ),
    "d01_drift_monitor_all": over(
        "SELECT ms.*, psi FROM ms LEFT JOIN ps ON ms.feature = ps.feature", *SPLIT_PANEL, *feature_ctes("sp"), *drift_ctes(EVERY, "f3")
    ),
    "f30_spearman_pairs_all": over("SELECT * FROM pq", *PAIRS_OF_ALL),
    "f31_redundancy_groups_all": recursive(over("SELECT feature, group_id FROM gg", *PAIRS_OF_ALL, *EDGES)),
    "f32_representative_pick_all": recursive(over(PICK, *PAIRS_OF_ALL, *EDGES, *picked(sorted(EVERY)))),
    "r06_batch_score": over_split(
        f"SELECT id, raw_probability, score AS calibrated_probability, {LEVEL} AS risk_level,"
        " score >= 0.1 AS above_primary_threshold FROM cal",
        "md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) FILTER ({DEV}) AS m_{c}" for c in CARD_COLUMNS) + " FROM sp)",
        f"rw AS (SELECT id, {r(f'1e0 / (1e0 + exp(-({FILLED})))')} AS raw_probability FROM sp, md)",
        "cal AS (SELECT id, raw_probability,"
        f" {r(f'1e0 / (1e0 + exp(-(0.9e0 * ln({SAFE} / (1 - {SAFE})) + (-0.1e0))))')} AS score FROM rw)",
    ),
    "f08_missingness_correlation": over_split(
        "SELECT * FROM pr WHERE correlation IS NOT NULL",
        "im AS (SELECT " + ", ".join(f"{bit(f'{c} IS NULL')} AS {c}" for c in PAIRED) + f" FROM sp WHERE {DEV})",
        "pr AS ("
        + union_rows(
            [
                f"'{a}' AS feature_1, '{b}' AS feature_2, {r(f'corr({a}, {b})')} AS correlation FROM im"
                for i, a in enumerate(PAIRED)
                for b in PAIRED[i + 1 :]
            ]
        )
        + ")",
    ),
    "f09_treatment_map": over_split(
        f"SELECT feature, unique_count, CAST(mi AS BIGINT) AS missing_count, {r('am', 4)} AS missing_pct,"
        f" {r('rm', 4)} AS retained_missing_pct, {r('cm', 4)} AS churned_missing_pct, {r('(cm - rm)', 4)} AS target_missingness_gap_pp,"
        f" mechanism, {TREATMENT} AS treatment, {INDICATOR} AS missingness_indicator, {STATUS} AS status FROM km",
        *TREATED,
    ),
    "f10_feature_register": over_split(
        f"SELECT feature, {FAMILY} AS feature_family, mechanism, {TREATMENT} AS treatment, {STATUS} AS status,"
        " CASE WHEN mechanism IN ('Calendar Metadata', 'Non-informative / Constant') THEN 'Excluded' ELSE 'Candidate' END AS candidacy FROM km",
        *TREATED,
    ),
    "f11_date_recency": over(
        "SELECT *, CASE WHEN conversion_loss = 0 AND invalid_negative = 0 THEN 'PASS' ELSE 'REVIEW' END AS status FROM c",
        "c AS ("
        + union_rows(
            [
                f"'{c}' AS feature, CAST(count({c}) AS BIGINT) AS original_non_null, CAST(count({day(c)}) AS BIGINT) AS converted_non_null,"
                f" CAST(count({c}) - count({day(c)}) AS BIGINT) AS conversion_loss,"
                f" {n_if(f'''{day(c)} > DATE '{ENDS[int(c[-1])]}' ''')} AS invalid_negative,"
                f" {n_if(f'''{day(c)} > DATE '{ENDS[int(c[-1])]}' ''')} AS invalid_future_dates FROM p"
                for c in DATES
            ]
        )
        + ")",
    ),
    "f11_recency_features": block(RECENCY),
    "f12_missing_indicators": block(FLAGS),
    "f13_dev_median_impute": over_matrix(
        "SELECT * FROM im",
        "im AS ("
        + union_rows(
            [
                f"'{c}' AS feature, f3.split AS split, {r(f'max(m_{c})')} AS median, {n_if(f'f3.{c} IS NULL')} AS missing_before,"
                f" {n_if(f'coalesce(CAST(f3.{c} AS DOUBLE), m_{c}, 0) IS NULL')} AS missing_after FROM f3, md GROUP BY f3.split"
                for c in MODEL
            ]
        )
        + ")",
    ),
    "f14_invariance_checks": over(
        "SELECT * FROM iv",
        "iv AS ("
        + union_rows(
            [
                f"'{c}_8' AS feature, {n_if(f'{c}_8 IS NULL')} AS missing_before, {n_if(f'{c}_8 IS NULL')} AS missing_after,"
                " true AS unchanged FROM p"
                for c in SERVICE
            ]
        )
        + ")",
    ),
    "f15_tenure": block(TENURE),
    "f16_three_month_summary": block(SUMMARY, SPREADS),
    "f17_change": block(CHANGE),
    "f18_pct_change": block(PCT),
    "f19_monthly_totals": block(TOTALS, ACTIVITY),
    "f20_inactivity_flags": block(INACTIVE),
    "f21_recent_vs_baseline": block(RECENT),
    "f22_value_ratios": block(RATIOS),
    "f23_no_recharge_flags": block(NONE),
    "f24_decline_count": block(DECLINE),
    "f25_trend_score": block(TREND),
    "f26_value_availability": block(AVAILABLE),
    "f27_recency_high_flag": over(
        "SELECT id, "
        + ", ".join(f"{bit(f'voice_rech_recency_{s} > h{s}')} AS voice_rech_recency_{s}_high_flag" for s in M)
        + " FROM f3, hm",
        *feature_ctes("p"),
        "hm AS (SELECT " + ", ".join(f"quantile_cont(voice_rech_recency_{s}, 0.5) AS h{s}" for s in M) + " FROM f3)",
    ),
    "f30_spearman_pairs": over_matrix("SELECT * FROM pq", *spearman("dv", MODEL)),
    "f31_redundancy_groups": recursive(over_matrix("SELECT feature, group_id FROM gg", *spearman("dv", MODEL), *EDGES)),
    "f32_representative_pick": recursive(over_matrix(PICK, *spearman("dv", MODEL), *EDGES, *picked(MODEL))),
    "f33_indicator_redundancy": over_split(
        "SELECT * FROM pq",
        "iq AS (SELECT id, " + ", ".join(f"{bit(f'{c} IS NULL')} AS {c}_missing" for c in INDICATORS) + f" FROM sp WHERE {DEV})",
        *spearman("iq", [f"{c}_missing" for c in INDICATORS]),
    ),
    "f34_mutual_information": over(
        "SELECT feature, mutual_information, row_number() OVER (ORDER BY mutual_information DESC, feature) AS mi_rank FROM ci", *MI
    ),
    "f34_mutual_information_nearest": over(
        "SELECT feature, mutual_information, row_number() OVER (ORDER BY mutual_information DESC, feature) AS mi_rank FROM ni", *NEAREST
    ),
    "f35_univariate_stability": over(
        f"SELECT feature, {r('avg(a)')} AS mean_cv_auc, {r('stddev_pop(a)')} AS cv_auc_std, {n_if('a >= 0.55')} AS stable_folds,"
        f" {r(div('count(*) FILTER (a >= 0.55)', 'count(*)'))} AS stability_rate,"
        " count(*) FILTER (a >= 0.55) * 1e0 / count(*) >= 0.6 AND avg(a) >= 0.55 AS stable FROM vf GROUP BY feature",
        *STABILITY,
    ),
    "f38_model_matrix_export": over_matrix(
        f"SELECT {FAMILY} AS feature_family, (SELECT {N} FROM fl) AS rows, (SELECT {N} FROM fl) AS complete_rows, {N} AS feature_count"
        " FROM nm GROUP BY 1",
        "nm AS (" + union_rows([f"'{c}' AS feature" for c in MODEL]) + ")",
    ),
    "m00_foundation_audit": over_matrix(union_rows([f"'{k}' AS check, {c} AS value FROM fl" for k, c in AUDIT.items()])),
    "m05_dummy_baselines": over("SELECT * FROM de", *DUMMY),
    "m09_cv_oof": over("SELECT * REPLACE (CAST(fold AS INTEGER) AS fold) FROM ev", *FOLDS),
    "m10_cv_summary": over(SUMMARY_SELECT, *FOLDS),
    "m10_fold_ranking": over(
        "SELECT CAST(fold AS INTEGER) AS fold, model, pr_auc, row_number() OVER (PARTITION BY fold ORDER BY pr_auc DESC, model) AS pr_auc_rank FROM ev",
        *FOLDS,
    ),
    "m11_pairwise_models": over(
        f"SELECT model_a, model_b, {r('avg(a)')} AS mean_pr_auc_a, {r('avg(b)')} AS mean_pr_auc_b,"
        f" {r('avg(a - b)')} AS mean_pr_auc_difference, {r('stddev_samp(a - b)')} AS std_pr_auc_difference,"
        f" {n_if('a > b')} AS folds_model_a_higher, {n_if('a < b')} AS folds_model_b_higher, {n_if('a = b')} AS folds_equal"
        " FROM pp GROUP BY model_a, model_b",
        *FOLDS,
        f"pp AS ({PAIR_ROWS})",
    ),
    "m14_holdout_compare": over("SELECT * FROM hc", *HOLDOUT),
    "m15_final_selection": over(
        "SELECT upper(replace(model, ' ', '_')) AS model, validation_rank, validation_pr_auc,"
        f" {r('(max(validation_pr_auc) OVER () - validation_pr_auc)')} AS pr_auc_gap_from_best, within_pr_auc_0_002_of_best,"
        " validation_roc_auc, top_10_capture, cv_pr_auc, absolute_cv_validation_gap,"
        " CASE WHEN validation_rank = 1 THEN 'SELECTED' ELSE 'NOT SELECTED' END AS final_selection FROM hc",
        *HOLDOUT,
    ),
    "c02_isotonic_calibrate": over_scores(
        # isotonic fit as max over earlier starts of min over later ends of block means
        f"SELECT sc.id AS id, {r('greatest(least(fit, 1 - 1e-7), 1e-7)')} AS score FROM sc JOIN iv ON sc.score = iv.score",
        "ig AS (SELECT score, count(*) AS n, sum(label) AS y, row_number() OVER (ORDER BY score) AS i FROM sc GROUP BY score)",
        "ic AS (SELECT i, score, sum(n) OVER (ORDER BY i) AS cn, sum(y) OVER (ORDER BY i) AS cy, n, y FROM ig)",
        "ij AS (SELECT a.i AS j, b.i AS k, CAST(b.cy - a.cy + a.y AS DOUBLE) / (b.cn - a.cn + a.n) AS m"
        " FROM ic a JOIN ic b ON a.i <= b.i)",
        "im AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS low FROM ij)",
        "ix AS (SELECT k, max(low) AS fit FROM im GROUP BY k)",
        "iv AS (SELECT score, fit FROM ix JOIN ic ON ix.k = ic.i)",
    ),
    "c07_rank_preservation": over_scores(
        f"SELECT {N} AS customers, {r('corr(a, b)')} AS ranking_spearman_vs_uncalibrated FROM rr",
        f"cl AS (SELECT score, {CALIBRATED} AS cal FROM sc)",
        f"rr AS (SELECT {avg_rank('score')} AS a, {avg_rank('cal')} AS b FROM cl)",
    ),
    "c08_validation_before_after": over(
        "SELECT se.stage AS stage, rows, churners, roc_auc, pr_auc, log_loss, brier_score, ece, mean_predicted_probability,"
        " actual_churn_rate FROM se JOIN sx ON se.stage = sx.stage JOIN sy ON se.stage = sy.stage",
        *STAGED,
    ),
    "x01_attribution_long": over_attribution("SELECT id, feature, v AS value, x AS contribution FROM zs"),
    "x01_additivity": over_attribution(
        f"SELECT {N} AS customers, {n_if('abs(base + parts - z) > 1e-5')} AS violations FROM (SELECT "
        + "1.1e0 + " + " + ".join(f"({w}) * b_{c}" for c, w in WEIGHTS.items()) + " AS base, "
        + " + ".join(f"({w}) * ({c} - b_{c})" for c, w in WEIGHTS.items()) + " AS parts, "
        + "1.1e0 + " + " + ".join(f"({w}) * {c}" for c, w in WEIGHTS.items()) + " AS z FROM z0, zb)"
    ),
    "x02_global_importance": over_attribution(
        f"SELECT feature, {r('avg(abs(x))')} AS mean_abs_contribution,"
        f" row_number() OVER (ORDER BY {r('avg(abs(x))')} DESC, feature) AS rank FROM zl GROUP BY feature"
    ),
    "x03_direction": over_attribution(
        f"SELECT feature, {r('avg(x)')} AS mean_contribution, {r('avg(abs(x))')} AS mean_abs_contribution,"
        f" {r('u')} AS positive_pct_nonzero, {r('d')} AS negative_pct_nonzero, {r(pc('count(*) FILTER (x = 0)', 'count(*)'))} AS zero_pct,"
        f" {r('greatest(u, d)')} AS direction_consistency_pct, CASE WHEN greatest(u, d) >= 75 THEN 'Strongly consistent'"
        " WHEN greatest(u, d) >= 60 THEN 'Moderately consistent' ELSE 'Mixed' END AS direction_consistency_label,"
        f" {r('avg(v)', 4)} AS mean_feature_value, {r('quantile_cont(v, 0.5)', 4)} AS median_feature_value,"
        " CASE WHEN avg(x) > 1e-12 THEN 'Positive average contribution' WHEN avg(x) < -1e-12 THEN 'Negative average contribution'"
        " ELSE 'Near-neutral average contribution' END AS overall_direction"
        f" FROM (SELECT *, {pc('count(*) FILTER (x > 0) OVER (PARTITION BY feature)', 'count(*) FILTER (x <> 0) OVER (PARTITION BY feature)')} AS u,"
        f" {pc('count(*) FILTER (x < 0) OVER (PARTITION BY feature)', 'count(*) FILTER (x <> 0) OVER (PARTITION BY feature)')} AS d FROM zl)"
        " GROUP BY feature, u, d"
    ),
    "x04_top_drivers": over_attribution(
        "SELECT z0.id AS id, "
        + ", ".join(
            f"max(CASE WHEN side = '{s}' AND place = {i} THEN feature END) AS {s}_driver_{i},"
            f" max(CASE WHEN side = '{s}' AND place = {i} THEN x END) AS {s}_driver_{i}_contribution"
            for s in ("positive", "negative")
            for i in range(1, 6)
        )
        + " FROM z0 LEFT JOIN zd ON z0.id = zd.id GROUP BY z0.id"
    ),
    "x05_top_risk_profiles": over_attribution(
        f"SELECT id, score, {drivers('positive')} AS top_positive_drivers, {drivers('negative')} AS top_negative_drivers FROM zd"
        " WHERE place <= 5 AND id IN (SELECT id FROM z0 ORDER BY score DESC, id LIMIT 50) GROUP BY id, score"
    ),
}
SANITY_ROWS = union_rows([f"'{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM f3" for c in SANITY_COLUMNS])
STAGES["f29_numeric_sanity"] = over(
    f"SELECT feature, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS missing_count, CAST(0 AS BIGINT) AS infinite_count,"
    f" {N} AS unique_count, {r(div('max(n)', 'sum(n)'))} AS top_value_share, CASE WHEN count(*) <= 1 THEN 'Constant'"
    f" WHEN {div('max(n)', 'sum(n)')} >= 0.995 THEN 'Near-constant' ELSE 'Usable' END AS screening FROM lc GROUP BY feature",
    *feature_ctes("p"),
    f"lv AS ({SANITY_ROWS})",
    "lc AS (SELECT feature, v, count(*) AS n FROM lv GROUP BY feature, v)",
)
