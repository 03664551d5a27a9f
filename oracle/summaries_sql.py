"""DuckDB text of the one-row reports and gates of the descriptive modules."""

from __future__ import annotations

from oracle.render import RANKED_CTE, pct, r, with_panel

M = (6, 7, 8)


def n_if(cond: str, name: str) -> str:
    return f"CAST(count(*) FILTER ({cond}) AS BIGINT) AS {name}"


def absent(column: str, name: str) -> str:
    return n_if(f"{column} IS NULL", name)


def mean(m: str, name: str) -> str:
    return f"{r(f'avg({m})')} AS {name}"


def mid(m: str, name: str) -> str:
    return f"{r(f'quantile_cont({m}, 0.5)')} AS {name}"


N = "CAST(count(*) AS BIGINT)"
DISTINCT = "CAST(count(DISTINCT id) AS BIGINT)"
RATE = pct("count(*) FILTER (label = 1)", "count(*)")


def over_m(*cols: str, where: str = "") -> str:
    return with_panel(f"SELECT {', '.join(cols)} FROM m{where}")


def status(cond: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN 'PASS' ELSE 'REVIEW' END AS {name}"


def any_month(cond: str, *ms: str) -> str:
    return "(" + " OR ".join(cond.format(f"{m}_{p}") for m in ms for p in M) + ")"


RECH = ("total_rech_amt", "total_rech_num", "max_rech_amt")
USE = ("total_og_mou", "total_ic_mou", "vol_2g_mb", "vol_3g_mb")
ENDS = {6: "12/31/1998", 7: "12/31/1999", 8: "12/31/2000"}
YEARS = {6: 1998, 7: 1999, 8: 2000}
WRONG_END = {p: f"last_date_of_month_{p} <> '{ENDS[p]}'" for p in M}
WRONG_DAY = {
    p: f"NOT (CAST(strptime(date_of_last_rech_{p}, '%m/%d/%Y') AS DATE)"
    f" BETWEEN DATE '{YEARS[p]}-01-01' AND DATE '{YEARS[p]}-12-31')"
    for p in M
}
CHECKS = {
    "Row count": "count(*) = 69999",
    "Customer ID integrity": "count(*) = count(id) AND count(*) = count(DISTINCT id)",
    "Target integrity": "count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) = 0",
    "AON validity": "count(*) FILTER (aon IS NULL OR aon <= 0) = 0",
    "Recharge validity": f"count(*) FILTER ({any_month('{} < 0', *RECH)}) = 0",
    "Usage validity": f"count(*) FILTER ({any_month('{} < 0', *USE)}) = 0",
    "Month-end dates": f"count(*) FILTER ({' OR '.join(WRONG_END.values())}) = 0",
}
CHECK_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, CASE WHEN {c} THEN 1 ELSE 0 END AS check_pass FROM m"
    for name, c in CHECKS.items()
)


def gate(counters: dict[str, str], names: tuple[str, str, str], out: str, zero: tuple[str, ...]) -> str:
    n, d, dup = names
    cols = [f"{N} AS {n}", f"{DISTINCT} AS {d}", f"CAST(count(*) - count(DISTINCT id) AS BIGINT) AS {dup}"]
    cols += [n_if(c, k) for k, c in counters.items()]
    ok = f"{n} = 69999 AND {d} = {n}" + "".join(f" AND {z} = 0" for z in zero)
    return with_panel(f"SELECT *, {status(ok, out)} FROM c", f"c AS (SELECT {', '.join(cols)} FROM m)")


def avail(column: str, name: str) -> str:
    return over_m(
        *[n_if(f"{column}_{p} IS NOT NULL", f"available_{name}_{p}") for p in M],
        *[absent(f"{column}_{p}", f"missing_{name}_{p}") for p in M],
    )


def from_ranked(inner: str, outer: str) -> str:
    return with_panel(f"SELECT {outer} FROM c", RANKED_CTE, f"c AS (SELECT {inner} FROM k)")


HIGH = "value_percentile >= 0.75"
FELL = {"arpu": "arpu_8 < arpu_7", "total_rech_amt": "total_rech_amt_8 < total_rech_amt_7"}
THREE = ("arpu", "total_rech_amt", "total_og_mou")
LABEL_GATE = gate(
    {"missing_target_values": "label IS NULL"},
    ("total_rows", "distinct_customer_ids", "duplicate_customer_ids"),
    "quality_gate_status",
    ("missing_target_values",),
)
MISSING = {
    "missing_target_count": "label IS NULL",
    "missing_arpu_8_count": "arpu_8 IS NULL",
    "missing_recharge_8_count": "total_rech_amt_8 IS NULL",
}
CHURNED_VALUE = "coalesce(sum(value) FILTER (label = 1), 0)"


def high_decline(m: str, change: str, out: str) -> str:
    return from_ranked(
        f"{n_if(f'{HIGH} AND {FELL[m]}', 'declining_customers')}, count(*) FILTER ({HIGH}) AS hv,"
        f" avg({change}) FILTER ({HIGH} AND {FELL[m]}) AS ch",
        f"declining_customers, {pct('declining_customers', 'hv')} AS share_of_high_value_customers_pct,"
        f" {r('ch')} AS {out}",
    )


SIGNALS = {
    "arpu_declining": "arpu_8 < arpu_7",
    "recharge_declining": "total_rech_amt_8 < total_rech_amt_7",
    "outgoing_declining": "total_og_mou_8 < total_og_mou_7",
    "incoming_declining": "total_ic_mou_8 < total_ic_mou_7",
    "broad_deterioration": " AND ".join(f"{m}_8 < {m}_7" for m in THREE),
    "broad_improvement": " AND ".join(f"{m}_8 > {m}_7" for m in THREE),
}
MONTH = {6: "june", 7: "july", 8: "august"}
SNAPSHOT = {
    "arpu": "arpu",
    "recharge": "total_rech_amt",
    "outgoing": "total_og_mou",
    "incoming": "total_ic_mou",
    "2g": "vol_2g_mb",
    "3g": "vol_3g_mb",
}

SUMMARIES: dict[str, str] = {
    "s01_0_context_counts": over_m(
        f"{N} AS row_count",
        "CAST(count(id) AS BIGINT) AS non_null_customer_ids",
        "CAST(count(label) AS BIGINT) AS non_null_targets",
    ),
    "s01_1_id_integrity": over_m(
        f"{N} AS row_count",
        "CAST(count(id) AS BIGINT) AS non_null_id_count",
        f"{DISTINCT} AS distinct_id_count",
        "CAST(count(*) - count(id) AS BIGINT) AS null_id_count",
        "CAST(count(*) - count(DISTINCT id) AS BIGINT) AS duplicate_id_rows",
    ),
    "s01_2_duplicate_ids": over_m("id", f"{N} AS occurrence_count", where=" GROUP BY id HAVING count(*) > 1"),
    "s01_3_label_validation": over_m(
        f"{N} AS total_rows",
        absent("label", "null_target_count"),
        n_if("label NOT IN (0, 1)", "invalid_target_count"),
        n_if("label = 0", "retained_count"),
        n_if("label = 1", "churned_count"),
        f"{RATE} AS churn_rate_percent",
        status("count(*) = count(*) FILTER (label IN (0, 1))", "validation_status"),
    ),
    "s01_5_constant_columns": with_panel(
        f"SELECT column_name, {N} AS row_count, CAST(count(DISTINCT v) AS BIGINT) AS distinct_value_count"
        " FROM u GROUP BY column_name",
        "u AS (SELECT 'circle_id' AS column_name, CAST(circle_id AS VARCHAR) AS v FROM m"
        " UNION ALL SELECT 'last_date_of_month_6', last_date_of_month_6 FROM m)",
    ),
    "s01_6_critical_nulls": over_m(
        absent("id", "missing_customer_id"),
        absent("label", "missing_target"),
        absent("arpu_8", "missing_arpu_8"),
        absent("total_rech_amt_8", "missing_recharge_amount_8"),
        absent("total_og_mou_8", "missing_outgoing_usage_8"),
        absent("total_ic_mou_8", "missing_incoming_usage_8"),
        status(
            "count(*) = count(id + label + arpu_8 + total_rech_amt_8 + total_og_mou_8 + total_ic_mou_8)",
            "validation_status",
        ),
    ),
    "s01_7_missingness_profile": over_m(
        absent("arpu_8", "arpu_8_missing"),
        absent("total_rech_amt_8", "recharge_amt_8_missing"),
        absent("total_og_mou_8", "outgoing_mou_8_missing"),
        absent("total_ic_mou_8", "incoming_mou_8_missing"),
        absent("date_of_last_rech_8", "last_rech_8_missing"),
        absent("date_of_last_rech_data_8", "last_data_rech_8_missing"),
        absent("total_rech_data_8", "total_data_rech_8_missing"),
    ),
    "s01_8_tenure_validity": over_m(
        "CAST(min(aon) AS BIGINT) AS minimum_aon",
        "CAST(max(aon) AS BIGINT) AS maximum_aon",
        mean("aon", "average_aon"),
        absent("aon", "null_aon_count"),
        n_if("aon <= 0", "invalid_aon_count"),
        status("count(*) = count(*) FILTER (aon > 0)", "validation_status"),
    ),
    "s01_9_recharge_validity": over_m(
        n_if(any_month("{} < 0", "total_rech_amt"), "negative_recharge_amount_rows"),
        n_if(any_month("{} < 0", "total_rech_num"), "negative_recharge_count_rows"),
        n_if(any_month("{} < 0", "max_rech_amt"), "negative_max_recharge_rows"),
        status(f"count(*) FILTER ({any_month('{} < 0', *RECH)}) = 0", "validation_status"),
    ),
    "s01_10_usage_validity": over_m(
        n_if(any_month("{} < 0", *USE[:2]), "negative_voice_usage_rows"),
        n_if(any_month("{} < 0", *USE[2:]), "negative_data_usage_rows"),
        status(f"count(*) FILTER ({any_month('{} < 0', *USE)}) = 0", "validation_status"),
    ),
    "s01_11_negative_value_profile": over_m(
        *[n_if(f"arpu_{p} < 0", f"negative_arpu_{p}_count") for p in M],
        *[f"min(arpu_{p}) AS minimum_arpu_{p}, max(arpu_{p}) AS maximum_arpu_{p}" for p in M],
        "'INVESTIGATE — source values retained; no automatic deletion' AS treatment_status",
    ),
    "s01_12_count_amount_conflict": over_m(
        *[n_if(f"total_rech_num_{p} > 0 AND total_rech_amt_{p} = 0", f"month_{p}_count") for p in M],
        "'INVESTIGATE — semantic/source behavior; not treated as automatic failure' AS treatment_status",
    ),
    "s01_13_month_end_dates": over_m(
        *[n_if(WRONG_END[p], f"invalid_month_{p}_dates") for p in M],
        *[absent(f"last_date_of_month_{p}", f"missing_month_{p}_dates") for p in M],
        status(CHECKS["Month-end dates"], "validation_status"),
    ),
    "s01_14_recharge_date_availability": avail("date_of_last_rech", "recharge_date"),
    "s01_15_data_recharge_date_availability": avail("date_of_last_rech_data", "data_recharge_date"),
    "s01_16_date_month_consistency": over_m(
        *[n_if(WRONG_DAY[p], f"invalid_recharge_month_{p}") for p in M],
        status(f"count(*) FILTER ({' OR '.join(WRONG_DAY.values())}) = 0", "validation_status"),
    ),
    "s01_18a_quality_gate_checks": with_panel(
        "SELECT check_name, check_pass, CASE check_pass WHEN 1 THEN 'PASS' ELSE 'REVIEW' END AS status FROM c",
        f"c AS ({CHECK_ROWS})",
    ),
    "s01_18b_quality_gate_summary": with_panel(
        f"SELECT {N} AS validation_checks, CAST(sum(check_pass) AS BIGINT) AS passed_checks,"
        " CAST(count(*) - sum(check_pass) AS BIGINT) AS failed_checks,"
        " CASE WHEN min(check_pass) = 1 THEN 'PASS' ELSE 'REVIEW' END AS overall_validation_status FROM c",
        f"c AS ({CHECK_ROWS})",
    ),
    "s02_01_churn_snapshot": over_m(
        f"{N} AS total_customers",
        n_if("label = 1", "churned_customers"),
        n_if("label = 0", "retained_customers"),
        f"{RATE} AS churn_rate_pct",
    ),
    "s02_16_quality_gate": over_m(
        f"{N} AS total_rows",
        f"{DISTINCT} AS distinct_customer_ids",
        n_if("label IN (0, 1)", "valid_target_rows"),
        status(
            "count(*) > 0 AND count(DISTINCT id) = count(*) AND count(*) FILTER (label IN (0, 1)) = count(*)",
            "analytical_readiness",
        ),
    ),
    "s03_01_profile_snapshot": over_m(
        f"{N} AS total_customers",
        mean("aon", "avg_tenure_days"),
        mid("aon", "median_tenure_days"),
        mean("arpu_8", "avg_august_arpu"),
        mid("arpu_8", "median_august_arpu"),
        mean("total_rech_amt_8", "avg_august_recharge_amount"),
        mean("total_rech_num_8", "avg_august_recharge_count"),
        mean("total_og_mou_8", "avg_august_outgoing_mou"),
        mean("total_ic_mou_8", "avg_august_incoming_mou"),
    ),
    "s03_15_quality_gate": LABEL_GATE,
    "s04_01_usage_snapshot": over_m(
        f"{N} AS total_customers",
        mean("total_og_mou_8", "avg_august_outgoing_mou"),
        mean("total_ic_mou_8", "avg_august_incoming_mou"),
        mean("onnet_mou_8", "avg_august_onnet_mou"),
        mean("offnet_mou_8", "avg_august_offnet_mou"),
        mean("vol_2g_mb_8", "avg_august_2g_mb"),
        mean("vol_3g_mb_8", "avg_august_3g_mb"),
        f"{RATE} AS overall_observed_churn_rate_pct",
    ),
    "s04_20_quality_gate": LABEL_GATE,
    "s05_01_revenue_snapshot": over_m(
        f"{N} AS customers",
        mean("aon", "avg_tenure_days"),
        mean("arpu_8", "avg_august_arpu"),
        mid("arpu_8", "median_august_arpu"),
        mean("total_rech_amt_8", "avg_august_recharge_amount"),
        mid("total_rech_amt_8", "median_august_recharge_amount"),
        mean("total_rech_num_8", "avg_august_recharge_frequency"),
        mean("total_og_mou_8", "avg_august_outgoing_mou"),
        mean("total_ic_mou_8", "avg_august_incoming_mou"),
        n_if("arpu_8 < 0", "negative_arpu_customers"),
        n_if("arpu_8 = 0", "zero_arpu_customers"),
        n_if("total_rech_amt_8 = 0", "zero_recharge_amount_customers"),
    ),
    "s05_17_quality_gate": gate(
        {
            "missing_august_arpu": "arpu_8 IS NULL",
            "missing_august_recharge_amount": "total_rech_amt_8 IS NULL",
            "missing_august_recharge_frequency": "total_rech_num_8 IS NULL",
            "negative_recharge_amounts": "total_rech_amt_8 < 0",
        },
        ("row_count", "distinct_customer_ids", "duplicate_id_count"),
        "analytical_quality_gate",
        (
            "missing_august_arpu",
            "missing_august_recharge_amount",
            "missing_august_recharge_frequency",
            "negative_recharge_amounts",
        ),
    ),
    "s06_01_service_snapshot": over_m(
        f"{N} AS customers",
        n_if("fb_user_8 = 1", "social_service_users"),
        n_if("night_pck_user_8 = 1", "night_service_users"),
        *[n_if(f"{k}_{g}_8 > 0", f"{k}_{g}_users") for k in ("monthly", "sachet") for g in ("2g", "3g")],
        n_if("total_rech_data_8 > 0", "data_recharge_users"),
        absent("total_rech_data_8", "missing_data_recharge_information"),
    ),
    "s06_15_quality_gate": gate(
        {
            "missing_target": "label IS NULL",
            "missing_data_recharge_information": "total_rech_data_8 IS NULL",
            "missing_social_service_information": "fb_user_8 IS NULL",
            "missing_night_service_information": "night_pck_user_8 IS NULL",
        },
        ("row_count", "distinct_customer_ids", "duplicate_id_count"),
        "analytical_quality_gate",
        ("missing_target",),
    ),
    "s07_01_temporal_snapshot": over_m(
        f"{N} AS customer_count", *[mean(f"{m}_{p}", f"avg_{k}_{MONTH[p]}") for k, m in SNAPSHOT.items() for p in M]
    ),
    "s07_15_temporal_signals": with_panel(
        "SELECT total_customers, "
        + ", ".join(f"{k}, {pct(k, 'total_customers')} AS {k}_pct" for k in SIGNALS)
        + " FROM c",
        f"c AS (SELECT {N} AS total_customers, {', '.join(n_if(c, k) for k, c in SIGNALS.items())} FROM m)",
    ),
    "s07_16_quality_gate": gate(
        {
            "missing_targets": "label IS NULL",
            "incomplete_arpu_history": any_month("{} IS NULL", "arpu"),
            "incomplete_recharge_history": any_month("{} IS NULL", "total_rech_amt"),
            "incomplete_outgoing_history": any_month("{} IS NULL", "total_og_mou"),
            "incomplete_incoming_history": any_month("{} IS NULL", "total_ic_mou"),
        },
        ("row_count", "distinct_customer_ids", "duplicate_customer_ids"),
        "analytical_quality_gate",
        ("missing_targets",),
    ),
    "s08_01_value_snapshot": over_m(
        f"{N} AS total_customers",
        f"{DISTINCT} AS distinct_customers",
        mean("arpu_8", "avg_august_arpu"),
        f"{r('min(arpu_8)')} AS min_august_arpu",
        f"{r('max(arpu_8)')} AS max_august_arpu",
        f"{r('sum(value)')} AS total_positive_august_value_proxy",
        f"{r(CHURNED_VALUE)} AS observed_churned_value_proxy",
    ),
    "s08_05_churned_value_exposure": over_m(
        f"{N} AS churned_customers",
        f"{r('sum(value)')} AS observed_churned_value_proxy",
        mean("value", "avg_churned_value_proxy"),
        f"{r('min(value)')} AS min_churned_value_proxy",
        f"{r('max(value)')} AS max_churned_value_proxy",
        where=" WHERE label = 1",
    ),
    "s08_07_pareto_deciles": with_panel(
        f"SELECT CAST(t AS BIGINT) AS value_decile, n AS customers, {r('v')} AS value_proxy,"
        f" {pct('v', 'sum(v) OVER ()')} AS value_share_pct,"
        f" {pct('sum(v) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)', 'sum(v) OVER ()')}"
        " AS cumulative_value_share_pct FROM d",
        "c AS (SELECT value, ntile(10) OVER (ORDER BY value DESC, id) AS t FROM m)",
        f"d AS (SELECT t, {N} AS n, sum(value) AS v FROM c GROUP BY t)",
    ),
    "s08_08_high_value_share": from_ranked(
        f"{n_if(HIGH, 'high_value_customers')}, count(*) AS n, sum(value) FILTER ({HIGH}) AS v, sum(value) AS a",
        f"high_value_customers, {pct('high_value_customers', 'n')} AS customer_share_pct,"
        f" {r('v')} AS high_value_proxy, {pct('v', 'a')} AS value_share_pct",
    ),
    "s08_09_high_value_churn": from_ranked(
        f"{n_if(f'{HIGH} AND label = 1', 'high_value_churned_customers')}, count(*) FILTER (label = 1) AS n,"
        f" sum(value) FILTER ({HIGH} AND label = 1) AS v, sum(value) FILTER (label = 1) AS a",
        "high_value_churned_customers,"
        f" {pct('high_value_churned_customers', 'n')} AS share_of_churned_customers_pct,"
        f" {r('v')} AS high_value_churned_proxy, {pct('v', 'a')} AS share_of_churned_value_proxy_pct",
    ),
    "s08_10_high_value_declining_value": high_decline("arpu", "arpu_change_pct", "avg_arpu_change_pct"),
    "s08_11_high_value_declining_recharge": high_decline(
        "total_rech_amt", "recharge_change_pct", "avg_recharge_change_pct"
    ),
    "s08_16_scenario_exposure": over_m(
        f"{r('sum(label * value)')} AS probability_weighted_value_exposure",
        f"{r(CHURNED_VALUE)} AS observed_churned_value_proxy",
        f"{r(CHURNED_VALUE + ' * 0.75e0')} AS conservative_recovery_scenario",
        f"{r(CHURNED_VALUE + ' * 0.5e0')} AS expected_recovery_scenario",
        f"{r(CHURNED_VALUE + ' * 0.25e0')} AS optimistic_recovery_scenario",
    ),
    "s08_17_value_signals": from_ranked(
        f"{N} AS total_customers, {n_if(HIGH, 'high_value_customers')},"
        f" {n_if(f'{HIGH} AND label = 1', 'high_value_churned_customers')}, sum(value) AS a,"
        f" sum(value) FILTER ({HIGH}) AS v, sum(value) FILTER ({HIGH} AND label = 1) AS c",
        f"total_customers, high_value_customers, high_value_churned_customers, {r('a')} AS total_value_proxy,"
        f" {r('v')} AS high_value_proxy, {r('c')} AS high_value_observed_churn_exposure,"
        f" {pct('v', 'a')} AS high_value_share_of_total_value_pct,"
        f" {pct('c', 'v')} AS high_value_observed_churn_exposure_pct",
    ),
    "s08_18_quality_gate": gate(
        MISSING, ("total_rows", "distinct_ids", "duplicate_id_count"), "analytical_quality_gate", tuple(MISSING)
    ),
    "s09_01_segment_universe": over_m(
        f"{N} AS total_customers",
        f"{DISTINCT} AS distinct_customers",
        "CAST(count(*) - count(DISTINCT id) AS BIGINT) AS duplicate_customer_ids",
        absent("label", "missing_churn_labels"),
        absent("arpu_8", "missing_arpu_8"),
        absent("total_rech_amt_8", "missing_recharge_8"),
        absent("total_og_mou_8", "missing_outgoing_voice_8"),
        absent("total_ic_mou_8", "missing_incoming_voice_8"),
    ),
    "s09_04_high_value_definition": from_ranked(
        f"{n_if(HIGH, 'high_value_customers')}, count(*) AS n, sum(value) FILTER ({HIGH}) AS v, sum(value) AS a",
        f"high_value_customers, {pct('high_value_customers', 'n')} AS high_value_customer_share_pct,"
        f" {r('v')} AS high_value_proxy, {pct('v', 'a')} AS high_value_contribution_pct",
    ),
    "s09_15_quality_gate": gate(
        MISSING,
        ("total_rows", "distinct_ids", "duplicate_id_count"),
        "segmentation_quality_gate",
        ("missing_target_count",),
    ),
    "s10_01_risk_value_snapshot": over_m(
        f"{N} AS total_customers",
        n_if("label = 1", "observed_churned_customers"),
        f"{RATE} AS observed_churn_rate_pct",
        mean("value", "avg_positive_value_proxy"),
        f"{r('sum(value)')} AS total_positive_value_proxy",
        f"{r(CHURNED_VALUE)} AS observed_churned_value_proxy",
    ),
    "s10_10_quality_gate": gate(
        MISSING, ("total_rows", "distinct_customer_ids", "duplicate_id_count"), "quality_gate", tuple(MISSING)
    ),
}
